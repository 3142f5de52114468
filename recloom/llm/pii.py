"""Personal data: sure patterns, and what stands in the contexts they are known to stand in.

The sure matches are seeds. The words before and after them are patterns; a pattern is trusted as far as the
instances in it are known, an instance as far as its patterns are trusted. A few rounds of this over the
pattern-instance graph of the whole corpus find identifiers in formats that no sure pattern covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recloom.llm.spans import Kind, covered, find, told
from recloom.llm.staging import stage_rows
from recloom.sources.staging import stage

_BEFORE = r"(?:(?<=(?<!\S)(\S{1,24})\s{1,2}))?"
_AFTER = r"(?:(?=[^\sA-Za-z0-9]{0,3}\s{1,2}(\S{1,24})(?!\S)))?"


def _kind(name: str, start: str, core: str, may: str) -> Kind:
    return Kind(name, start + _BEFORE + core + _AFTER, may, 1, 2)


# A run of characters fails as a whole or not at all, so matches may only begin where a run or the last match
# ends: that, and possessive repeats, keep long runs linear without changing the matches.
KINDS = [
    _kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))(?=[A-Za-z0-9._%+-])",
        r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "contains(text, '@')",
    ),
    _kind("ip", r"(?:\G|(?<![0-9]))(?=[0-9])", r"[0-9]++(?:\.[0-9]++){3}", "text rlike '[0-9][.][0-9]'"),
    _kind("card", r"(?=(?:[0-9][\x20-]?+){13}[0-9])", r"[0-9]++(?:[\x20-][0-9]++)*+", "text rlike '[0-9][ -]?[0-9]'"),
    _kind("phone", r"(?=\+[0-9])", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')"),
    # whatever looks like an identifier
    _kind("token", r"(?<!\S)(?=\S*[0-9@])", r"\S*[0-9A-Za-z]", "text rlike '[0-9@]'"),
]
BASE = ["email", "ip", "card", "phone"]
ROUNDS = 3
SUPPORT = 3.0  # known instances that a pattern needs
TRUST = 0.5  # of a pattern
ACCEPT = 0.6  # of an instance


def _digits() -> Column:
    return F.regexp_replace("match", "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits."""

    def step(total, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _sure() -> Column:
    """Which matches are base spans."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    n = F.length(_digits())
    return (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", F.col("match").rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(F.col("kind") == "card", F.when(n.between(14, 19), _luhn(_digits())).otherwise(F.lit(False)))
        .when(F.col("kind") == "phone", n.between(10, 15))
        .otherwise(F.lit(False))
    )


def _fits() -> Column:
    """Which kinds a token may be, by its characters alone."""
    n, letters = F.length(_digits()), F.col("match").rlike("[A-Za-z]")
    may = {
        "email": F.col("match").rlike("[^@]@[^@]"),
        "ip": F.col("match").rlike("^[0-9A-Fa-f]*[:.][0-9A-Fa-f:.]+$"),
        "card": ~letters & n.between(12, 24),
        "phone": ~letters & n.between(6, 17),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in may.items()]))


def _words() -> Column:
    """The context patterns of a match: the word before and the word after, digits made equal."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"[0-9]", "0"), r"^\W+(?=\w)|(?<=\w)\W+$", "")
    sides = [F.when(F.col(c) != "", F.concat(F.lit(f"{c}:"), norm(F.col(c)))) for c in ("left", "right")]
    return F.array_compact(F.array(*sides))


def discover(parts: DataFrame) -> DataFrame:
    """Instances that trusted patterns tie to a kind: (instance, kind). ``parts``: matches with sure and fits."""
    known = parts.filter("kind is not null").withColumn("instance", F.xxhash64("match"))
    edges = known.select(
        F.explode(_words()).alias("pattern"), "instance", F.when(F.col("sure"), F.col("kind")).alias("seed"), "fits"
    )
    edges = edges.groupBy("pattern", "instance").agg(F.min("seed").alias("seed"), F.first("fits").alias("fits"))
    edges = stage_rows(edges, "graph", 2 * known.count())
    seeds = edges.filter("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    seeds = seeds.distinct()
    width = edges.groupBy("pattern").agg(F.count("*").alias("width"))
    wanted = edges.filter("seed is null").select("pattern", "instance", F.explode("fits").alias("kind"))
    found, rows = None, wanted.count()
    for _ in range(ROUNDS):
        scores = seeds if found is None else seeds.unionByName(found)
        mass = edges.select("pattern", "instance").join(scores, "instance")
        mass = mass.groupBy("pattern", "kind").agg(F.sum("score").alias("mass")).filter(F.col("mass") >= SUPPORT)
        trust = mass.join(width, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("width") + 1)).alias("trust"))
        voted = wanted.join(trust.filter(F.col("trust") >= TRUST), ["pattern", "kind"])
        doubt = F.sum(F.log1p(-F.least("trust", F.lit(0.999))))
        found = voted.groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score"))
        found = stage_rows(found.filter(F.col("score") >= ACCEPT), "found", rows)
    best = F.max(F.struct("score", F.when(F.lit(True), F.col("kind")).alias("kind"))).alias("best")
    return found.groupBy("instance").agg(best).select("instance", F.col("best.kind").alias("as_kind"))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    The counts and the hash are of base spans; ``spans`` also has what the contexts gave away, under the kind
    that their patterns belong to. Null and empty texts have no span. Repeated rows and null ids are reported
    like any other row. An empty table gives an empty result; other columns are ignored.
    """
    found = find(docs, KINDS, id_col, text_col).withColumn("sure", _sure())
    found = found.withColumn("kind", F.when(F.col("sure") | (F.col("kind") == "token"), F.col("kind")))
    found = found.withColumn("covered", covered(F.col("sure")) & (F.col("kind") == "token"))
    found = found.withColumn("kind", F.when(~F.col("covered"), F.col("kind")))
    parts = stage(found.drop("covered").withColumn("fits", F.when(F.col("kind") == "token", _fits())), "matches")
    tokens = parts.filter("kind = 'token'").withColumn("instance", F.xxhash64("match"))
    more = tokens.join(discover(parts), "instance").select("row", "doc_id", "as_kind", "start", "stop")
    base = parts.select("row", "doc_id", F.when(F.col("sure"), F.col("kind")).alias("kind"), "start", "stop")
    spans = base.withColumn("base", F.lit(True)).unionByName(
        more.withColumnRenamed("as_kind", "kind").withColumn("base", F.lit(False))
    )
    return (
        spans.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE],
            F.sha2(told(BASE, F.col("base") & F.col("kind").isNotNull()), 256).alias("base_sha256"),
            told(BASE).alias("spans"),
            F.count(F.when(~F.col("base"), 1)).alias("n_found"),
        )
        .drop("row")
    )
