"""Secrets, and weak candidates that count only beside complementary parts of the same credential."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recloom.llm.spans import Kind, covered, find, redact, told
from recloom.sources.staging import stage

_NAMES = "(password|passwd|secret|token|api_?key)"
ASSIGN = rf"(?i:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGNS = "(contains(text, ':') or contains(text, '='))"
KINDS = [
    Kind("assign", ASSIGN, ASSIGNS),
    Kind("access", r"AKIA[A-Z0-9]+", "contains(text, 'AKIA')"),
    Kind("hex", r"[0-9a-f]{32,}", "text rlike '[0-9a-f]{32}'"),
    # parts that are weak alone: an identifier, a token that looks random, the place it opens
    Kind(
        "identifier",
        r"(?i:(?:client|access|account|key|user)[_-]?(?:id|name)?|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{4,}",
        ASSIGNS,
    ),
    Kind(
        "random",
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}",
        "text rlike '[0-9]'",
    ),
    Kind(
        "endpoint",
        r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._:@/?&=%-]{4,}|(?i:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.:-]{4,}",
        ASSIGNS,
    ),
]
BASE, ORDER = ["assign", "access", "hex"], ["assign", "access", "hex", "identifier", "random", "endpoint"]
SCOPE = 200  # code points between complementary parts
ROLE = {"assign": "secret", "hex": "secret", "random": "secret", "access": "identifier"}


def _role() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair]), F.col("kind"))


def _strong() -> Column:
    """Which matches are base spans."""
    secret = F.regexp_extract(F.col("match"), ASSIGN, 2)
    return (
        F.when(F.col("kind") == "assign", F.length(secret) >= 8)
        .when(F.col("kind") == "access", F.length("match") >= 16)
        .otherwise(F.col("kind") == "hex")
    )


def _plausible() -> Column:
    """Random-looking tokens mix cases and digits, or are long lower-case hex; other weak parts pass."""
    m = F.col("match")
    mixed = m.rlike("[A-Z]") & m.rlike("[a-z]") & (F.length(F.regexp_replace(m, "[^0-9]", "")) >= 2)
    return (F.col("kind") != "random") | mixed | m.rlike("^[0-9a-f]{16,31}$")


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``spans.find`` that matter, written once, with strong (a base span) and role."""
    found = find(docs, KINDS, id_col, text_col).withColumn("strong", _strong())
    keep = F.col("kind").isNull() | F.col("strong") | (~F.col("kind").isin(BASE) & _plausible())
    found = found.withColumn("kind", F.when(keep, F.col("kind"))).withColumn("role", F.coalesce(_role(), F.col("kind")))
    return stage(found.withColumn("role", F.when(F.col("kind").isNotNull(), F.col("role"))), "parts")


def linked(parts: DataFrame) -> DataFrame:
    """Weak parts outside base spans with a part of another role at most ``SCOPE`` code points away.

    The interval join runs over blocks of ``SCOPE`` code points: a part is looked up in the blocks that it and
    its neighbourhood touch. It only asks whether a partner exists, so crowded scopes make no pairs. One of the
    two must be a secret.
    """
    known = parts.filter("kind is not null")
    known = known.withColumn("covered", covered(F.col("strong"))).filter("strong or not covered")
    block = lambda c, by: F.floor((F.col(c) + by) / SCOPE)
    weak = known.filter("not strong").withColumn(
        "block", F.explode(F.sequence(block("start", -SCOPE), block("stop", SCOPE)))
    )
    every = known.withColumn("block", F.explode(F.sequence(block("start", 0), block("stop", 0))))
    w, s = weak.alias("w"), every.select("row", "block", "role", "start", "stop").alias("s")
    near = F.expr(
        f"s.start <= w.stop + {SCOPE} and s.stop >= w.start - {SCOPE} and (s.start >= w.stop or s.stop <= w.start)"
        " and w.row = s.row and w.block = s.block and s.role <> w.role and (s.role = 'secret' or w.role = 'secret')"
    )
    return w.join(s, near, "left_semi").select("row", "doc_id", "key", "kind", "start", "stop").dropDuplicates()


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base spans and linked parts of every row; a row without any keeps a line with a null kind."""
    parts = find_parts(docs, id_col, text_col)
    kind = F.when(F.col("strong"), F.col("kind")).alias("kind")
    return parts.select("row", "doc_id", "key", kind, "start", "stop").unionByName(linked(parts))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Null and empty texts have no span. Repeated rows and null ids are reported like any other row. An empty
    table gives an empty result; other columns are ignored.
    """
    base = F.col("kind").isin(BASE)
    return (
        _spans(docs, id_col, text_col)
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
            F.sha2(told(ORDER, base), 256).alias("base_sha256"),
            told(ORDER).alias("spans"),
            F.count(F.when(~base, 1)).alias("n_linked"),
        )
        .drop("row")
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every base span and linked part replaced by ``mark``; linked endpoints stay readable.

    Rows and columns stay; a null text stays null. Rows of equal id and text are redacted alike.
    """
    hit = _spans(docs, id_col, text_col).filter("kind is not null and kind <> 'endpoint'")
    spans = hit.groupBy(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key")).agg(
        F.collect_set(F.struct("start", "stop")).alias("hit_spans")
    )
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    packed = packed.select(
        "r", F.col(f"r.`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"r.`{text_col}`")).alias("key")
    )
    joined = packed.join(spans, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    text = F.col(f"r.`{text_col}`")
    clean = F.when(F.col("hit_spans").isNull(), text).otherwise(redact(text, F.col("hit_spans"), mark))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(f"r.`{c}`").alias(c) for c in docs.columns])
