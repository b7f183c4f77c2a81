"""Settings, read once on the driver and passed on as values; and the guard that keeps manuscripts on the machine."""

from __future__ import annotations

import ipaddress
import os
import re
from dataclasses import dataclass, fields
from pathlib import Path
from urllib.parse import urlsplit

PREFIX = "QUILLSPARK_"


class ConfidentialityError(RuntimeError):
    """Something would send the manuscript or its sources off the machine."""


@dataclass(frozen=True)
class Settings:
    llm_provider: str = "litellm"
    verify_model: str = "ollama/qwen3"
    embedding_model: str = "st-all-MiniLM-L6-v2"
    ollama_api_base: str = "http://localhost:11434"
    evidence_k: int = 10
    passages_per_claim: int = 10
    chunk_chars: int = 1500
    bibliography_budget: int = 6000
    lookup_concurrency: int = 4
    download_bytes: int = 50_000_000


def load(env: dict[str, str] | None = None, dotenv: str | None = ".env") -> Settings:
    """From a .env file and, over it, the environment; unknown names are left out."""
    found: dict[str, str] = {}
    if dotenv and Path(dotenv).is_file():
        pairs = (line.split("=", 1) for line in Path(dotenv).read_text().splitlines() if "=" in line and not line.lstrip().startswith("#"))
        found = {k.strip(): v.strip().strip("\"'") for k, v in pairs}
    found |= dict(os.environ if env is None else env)
    values = {f.name: f.type in (int, "int") and int(found[name]) or found[name] for f in fields(Settings) if (name := PREFIX + f.name.upper()) in found}
    return Settings(**values)


def is_local_model(model: str) -> bool:
    return model.lower().startswith(("ollama/", "st-"))


def is_local_host(base: str) -> bool:
    """The same rule as ``functions.identifiers.is_local_host``, for one address on the driver. What can't be read isn't local."""
    try:
        host = urlsplit(base if "://" in base else f"http://{base}").hostname or ""
    except ValueError:
        return False
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return host == "localhost" or host.endswith(".local") or bool(re.fullmatch(r"[a-z0-9_-]*[a-z_-][a-z0-9_-]*", host))
    nets = ("127.0.0.0/8", "10.0.0.0/8", "192.168.0.0/16", "172.16.0.0/12", "100.64.0.0/10", "0.0.0.0/32", "::1/128", "fe80::/10", "fc00::/7")
    return any(ip in ipaddress.ip_network(net) for net in nets)


def assert_local_only(s: Settings) -> None:
    """Raises unless the provider, both models and the address are local; to be called before any work."""
    wrong = []
    if s.llm_provider != "litellm":
        wrong.append(f"llm_provider {s.llm_provider!r} is not a local provider")
    wrong += [f"{name} {model!r} is not a local model" for name, model in (("verify_model", s.verify_model), ("embedding_model", s.embedding_model)) if not is_local_model(model)]
    if not is_local_host(s.ollama_api_base):
        wrong.append(f"ollama_api_base {s.ollama_api_base!r} is not a local address")
    if wrong:
        raise ConfidentialityError("; ".join(wrong))
