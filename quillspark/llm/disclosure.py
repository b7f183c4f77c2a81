"""PII removal with information-theoretic sanitisation.

Direct identifiers are found by pattern: e-mail, IP and card numbers (Luhn), phone numbers, and secrets (keys, tokens, passwords). Masking
those is not enough where the words around them give them away, so the corpus says how strongly a term reveals an entity (one address,
one number, one secret). With N words, n(e) places of the entity, n(t) places of the term and n(t, e) places of the term near the entity,
the share of the entity's information that the term carries is

    log2(n(t, e) N / (n(t) n(e))) / log2(N / n(e)),

its pointwise mutual information over the entity's information content: 1 if the term stands nowhere else. Near that entity, terms from
``remove_at`` on are removed and those from ``generalise_at`` on are generalised: the corpus's words form a hierarchy by their beginnings,
and a term becomes its longest beginning whose words, together, carry less than ``generalise_at`` (or goes, if there is none). Documents
without an entity are left alone. Every pair is scored, in however few documents it stands: the term's own n(t) tells common words from
telling ones. Counts cover all documents. Only DataFrame functions are used.

Defined results: null text counts as empty; rows with equal id and text are alike, and both count; a null id is handed through; names of
other columns don't matter.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matches import nowhere, places
from .scratch import written

KINDS = ("email", "ip", "card", "phone")
#: The patterns, leftmost non-overlapping. Runs can't match from their middle (or only just after a match), so
#: matching is made possessive and starts only there; the matches are the same, without backtracking over long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match.
MARKS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
#: Secrets: prefixes that issuers give their keys, key files, and values assigned to a telling name; a value has a digit. No look-around, so
#: that SQL engines without it read the same pattern.
def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key", "client_secret")))
SECRET = "|".join(
    (
        r"(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}",
        r"gh[pousr]_[A-Za-z0-9]{36}",
        r"github_pat_[A-Za-z0-9_]{22,}",
        r"glpat-[A-Za-z0-9_-]{20}",
        r"xox[abprs]-[A-Za-z0-9-]{10,}",
        r"AIza[A-Za-z0-9_-]{35}",
        r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
        r"sk-[A-Za-z0-9_-]{20,}",
        r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
        rf"(?:{_NAMES})[\"']?[\x20\x09]*[:=][\x20\x09]*[\"']?[!#-&(-~]{{8,}}",
    )
)
#: Every match has one of these, as it stands or in lower case; texts without are not searched.
SECRET_MARKS = ("AKIA", "ASIA", "AROA", "AIDA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "AIza", "k_live_", "k_test_", "sk-", "eyJ", "PRIVATE KEY")
SECRET_NAMES = ("passw", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key")
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"

#: Parameters of the sanitisation: characters looked at on either side of an entity, thresholds.
REACH = 80
#: Letters of the shortest beginning that a term is generalised to.
LEAST = 3
GENERALISE_AT, REMOVE_AT = 0.95, 0.99
TERM = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'_-]{2,}"
#: Terms whose counts are gathered by a broadcast of the terms; more are joined by a shuffle.
MOST_BROADCAST = 200_000

SPAN = "array<struct<kind:string,start:int,end:int,found:string>>"
NEAR = "array<struct<entity:bigint,term:string,start:int,end:int>>"


def luhn(found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    digits = F.length(F.regexp_replace(found, "[^0-9]", ""))
    if kind == "ip":
        return found.rlike(OCTETS)
    if kind == "card":
        return F.when((digits >= 13) & (digits <= 19), luhn(found)).otherwise(False)
    if kind == "phone":
        return (digits >= 9) & (digits <= 15)
    return F.lit(True)


def identifiers(text: Column, kind: str) -> Column:
    """Spans of one kind, in code points."""
    hits = F.when(text.rlike(MARKS[kind]), places(text, F.lit(PATTERNS[kind]))).otherwise(nowhere())
    valid = F.filter(hits, lambda h: _valid(kind, h["found"]))
    return F.transform(valid, lambda h: F.struct(F.lit(kind).alias("kind"), h["start"].alias("start"), h["end"].alias("end"), h["found"].alias("found"))).cast(SPAN)


def secrets(text: Column) -> Column:
    """Spans of keys, tokens and passwords."""
    low = F.lower(text)
    may = reduce(or_, [F.contains(text, F.lit(x)) for x in SECRET_MARKS] + [F.contains(low, F.lit(x)) for x in SECRET_NAMES])
    hits = F.when(may, places(text, F.lit(SECRET))).otherwise(nowhere())
    telling = F.filter(hits, lambda h: h["found"].rlike("[0-9]|PRIVATE KEY"))
    return F.transform(telling, lambda h: F.struct(F.lit("secret").alias("kind"), h["start"].alias("start"), h["end"].alias("end"), h["found"].alias("found"))).cast(SPAN)


def entity(span: Column) -> Column:
    """A number for an identifier, whatever its punctuation or case; secrets as they are."""
    plain = F.when(span["kind"] == "email", F.lower(span["found"])).when(span["kind"] == "secret", span["found"]).otherwise(F.regexp_replace(span["found"], "[^0-9.]", ""))
    return F.xxhash64(span["kind"], plain)


def near(text: Column, spans: Column) -> Column:
    """array<entity, term, start, end>: the words within REACH characters of each span and outside of all spans."""

    def around(span: Column) -> Column:
        low = F.greatest(span["start"] - REACH, F.lit(0))
        left = F.substring(text, low + 1, span["start"] - low)
        left_cut = F.when(low > 0, F.regexp_replace(left, r"^\S*", "")).otherwise(left)
        right = F.substring(text, span["end"] + 1, F.lit(REACH))
        right_cut = F.when(F.length(text) > span["end"] + REACH, F.regexp_replace(right, r"\S*\z", "")).otherwise(right)  # $ would match before a last line feed too

        def terms(part: Column, base: Column) -> Column:
            return F.transform(
                places(part, F.lit(TERM)),
                lambda w: F.struct(entity(span).alias("entity"), F.lower(w["found"]).alias("term"), (w["start"] + base).alias("start"), (w["end"] + base).alias("end")),
            )

        return F.concat(terms(left_cut, span["start"] - F.length(left_cut)), terms(right_cut, span["end"])).cast(NEAR)

    found = F.flatten(F.transform(spans, around))
    return F.filter(found, lambda w: ~F.exists(spans, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _share(n_te: Column, n_t: Column, n_e: Column, total: Column) -> Column:
    return F.try_divide(F.log2(n_te * total / (n_t * n_e)), F.log2(total / n_e))


def _generalised(flagged: DataFrame, entities: DataFrame, beside: DataFrame, vocabulary: DataFrame, total: Column, generalise_at: float) -> DataFrame:
    """flagged with ``put``: what stands for the term, the longest beginning that reveals less, or nothing."""
    kept = flagged.where("not remove").select("entity", "term")
    steps = kept.where(F.length("term") > LEAST).withColumn("size", F.explode(F.sequence(F.lit(LEAST), F.length("term") - 1)))
    steps = written(steps.select("entity", "term", F.expr("left(term, size)").alias("begin")), "pii-steps")
    wanted = written(steps.select("begin").distinct(), "pii-begins")

    def begins(words: DataFrame, *keys: str) -> DataFrame:
        """Sums over the words with each wanted beginning."""
        long = words.where(F.length("term") >= LEAST).withColumn("size", F.explode(F.sequence(F.lit(LEAST), F.length("term"))))
        return long.select(*keys, F.expr("left(term, size)").alias("begin"), "n").join(wanted, "begin").groupBy(*keys, "begin").agg(F.sum("n").alias("n"))

    n_t = begins(vocabulary.select("term", F.col("n_t").alias("n"))).withColumnRenamed("n", "n_t")
    n_te = begins(beside.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n")), "entity").withColumnRenamed("n", "n_te")
    scored = steps.join(n_te, ["entity", "begin"]).join(n_t, "begin").join(entities, "entity")
    scored = scored.where(_share(F.col("n_te"), F.greatest("n_t", "n_te"), F.col("n_e"), total) < generalise_at)
    best = scored.groupBy("entity", "term").agg(F.max(F.struct(F.length("begin").alias("size"), "begin"))["begin"].alias("begin"))
    return flagged.join(best, ["entity", "term"], "left").select("entity", "term", "remove", F.coalesce(F.concat("begin", F.lit("*")), F.lit("")).alias("put"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term and, if asked for, clean_text."""
    text, doc = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    source = docs.select(doc.alias("doc_id"), text.alias("text"))
    found = source.select("doc_id", "text", *[identifiers(F.col("text"), k).alias(k) for k in KINDS], secrets(F.col("text")).alias("secret"))
    found = found.select("doc_id", "text", *[F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, "secret")], F.concat(*KINDS).alias("base"), F.concat(*KINDS, "secret").alias("own"))
    words = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1
    counts = [f"n_{k}" for k in (*KINDS, "secret")]
    table = found.select("doc_id", F.xxhash64("text").alias("tkey"), words.alias("words"), *counts, "base", "own", F.when(F.size("own") > 0, near(F.col("text"), F.col("own"))).otherwise(F.array().cast(NEAR)).alias("near"))
    table = written(table, "pii-spans")

    total = F.lit(float(max(2, table.agg(F.sum("words")).first()[0] or 2)))
    entities = table.where(F.size("own") > 0).select(F.explode(F.transform("own", entity)).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    beside = table.where(F.size("near") > 0).select("doc_id", "tkey", F.explode("near").alias("w")).select("doc_id", "tkey", "w.*")
    pairs = written(beside.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")), "pii-pairs")
    # a term inside an identifier is no place of its own
    inside = table.where(F.size("own") > 0).select(F.explode("own").alias("s")).select(F.explode(F.regexp_extract_all(F.lower("s.found"), F.lit(TERM), F.lit(0))).alias("term"))
    inside = inside.groupBy("term").agg(F.count(F.lit(1)).alias("n_in"))
    if pairs.limit(1).isEmpty():
        flagged = pairs.select("entity", "term", F.lit(True).alias("remove"), F.lit("").alias("put"))
    else:
        terms = written(pairs.select("term").distinct(), "pii-terms")
        places_of = source.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term"))
        if not with_text and terms.count() <= MOST_BROADCAST:
            places_of = places_of.join(F.broadcast(terms), "term")
        everywhere = places_of.groupBy("term").agg(F.count(F.lit(1)).alias("n"))  # beyond that, counts are joined below, not places
        vocabulary = everywhere.join(inside, "term", "left").select("term", (F.col("n") - F.coalesce("n_in", F.lit(0))).alias("n_t"))
        if with_text:
            vocabulary = written(vocabulary, "pii-words")
        # a word cut otherwise in the whole text than beside an entity has at least the places seen there
        share = _share(F.col("n_te"), F.greatest("n_t", "n_te"), F.col("n_e"), total)
        scored = pairs.join(entities, "entity").join(vocabulary, "term").withColumn("share", share)
        flagged = written(scored.where(F.col("share") >= generalise_at).select("entity", "term", (F.col("share") >= remove_at).alias("remove")), "pii-flagged")
        flagged = _generalised(flagged, entities, beside, vocabulary, total, generalise_at) if with_text else flagged.withColumn("put", F.lit(""))
    # the strictest rule of a place counts, if it stands near several entities
    marks = beside.join(flagged, ["entity", "term"]).groupBy("doc_id", "tkey", "start", "end").agg(F.min(F.struct(F.length("put").alias("size"), "put"))["put"].alias("put"))
    marks = marks.groupBy(F.col("doc_id").alias("r_id"), F.col("tkey").alias("r_key")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "put"))).alias("terms"))
    joined = table.join(marks, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("tkey") == F.col("r_key")), "left")
    more = F.coalesce(F.transform("terms", lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["put"].alias("found"))).cast(SPAN), F.array().cast(SPAN))
    out = joined.select("doc_id", "tkey", *counts, F.size(more).cast("long").alias("n_term"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), F.concat("own", more).alias("all"))
    shown = ["doc_id", *counts[:-1], "base_sha256", _joined(F.col("all")).alias("spans"), "n_secret", "n_term"]
    if not with_text:
        return out.select(*shown)
    # the text is only needed where something is replaced
    rest = source.select(F.col("doc_id").alias("t_id"), F.xxhash64("text").alias("t_key"), "text").dropDuplicates(["t_id", "t_key"])
    full = out.join(rest, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("tkey") == F.col("t_key")))
    return full.select(*shown, cleaned(F.col("text"), F.col("all")).alias("clean_text"))


def cleaned(text: Column, spans: Column) -> Column:
    """The text with identifiers replaced by their kind, and terms as their span says; of overlapping spans the first counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.when(s["kind"] == "term", s["found"]).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]"))).alias("put"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        after = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["put"])
        return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), F.when(after, piece).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
