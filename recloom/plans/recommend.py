"""The whole recommendation job: requests in; rails, traces and the inference log out."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions.scalars import instant
from recloom.plans import candidates, rails, traces
from recloom.plans.scoring import Scorer
from recloom.schemas import AFFINITY_COLUMNS
from recloom.sources.staging import stage
from recloom.sources.tables import append


@dataclass(frozen=True)
class Context:
    """What a ranking run reads: dimensions, live policies and the batch feature tables."""

    regions: DataFrame
    categories: DataFrame
    items: DataFrame
    players: DataFrame
    policies: Mapping[str, DataFrame]
    affinity: DataFrame
    behavior: DataFrame
    market: DataFrame  # staged candidates.market_items
    columns: Mapping[int, str]
    region_pattern: str = "^[A-Za-z]{2,5}$"
    default_region: str = "UK"


@dataclass(frozen=True)
class Recommendations:
    """Lazy results of one run; every frame covers all requests.

    ``ranked`` is the part of ``scored`` that may be in a rail. Where it takes a look at every candidate, it is found
    and written when it, the rails or the traces are first asked for.
    """

    requests: DataFrame
    market: DataFrame
    candidates: DataFrame
    scored: DataFrame
    decisions: DataFrame
    inference: DataFrame
    model_version: str
    generated_at: str
    longest: int
    find_ranked: Callable[[], DataFrame]
    latency: DataFrame | None = None

    @cached_property
    def ranked(self) -> DataFrame:
        return self.find_ranked()

    @cached_property
    def rails(self) -> DataFrame:
        return rails.rails(self.ranked, self.longest)

    @cached_property
    def traces(self) -> DataFrame:
        told = traces.decisions(traces.with_shown(self.requests, self.rails), self.market)
        return traces.traces(told, self.rails, self.model_version, self.generated_at, self.latency)

    def write(self, root: str) -> None:
        """Append output, trace and inference log; any failure fails the job."""
        append(traces.recommendation_rows(self.rails, self.model_version, self.generated_at), root, "recommendation_output")
        append(self.traces, root, "recommendation_trace")
        append(self.inference, root, "ranker_inference_log")


def recommend(
    requests: DataFrame,
    context: Context,
    scorer: Scorer,
    generated_at: str,
    model_version: str,
    recent: DataFrame | None = None,
    norm_scope: str = "market",
    catalog: DataFrame | None = None,
    latency: DataFrame | None = None,
    item_part: str | None = None,
) -> Recommendations:
    """Resolve, assemble, filter by policy, score, cut into rails and trace.

    ``scored`` and the inference log always cover every candidate. The rails do too, unless the
    scorer is additive and its ``item_part`` is given: then only the items that can reach a rail
    (``candidates.heads``, once per market) are expanded for them, with the same result. Otherwise all candidates
    are met twice: first for what a candidate must reach (``rails.floors``), then to keep those that do, so none of
    the others is sorted.
    """
    resolved = candidates.resolve_requests(
        requests, context.players, context.regions, context.region_pattern, context.default_region
    )
    carry = ("top_n",)
    if "because_you_played" in requests.columns:
        resolved, carry = rails.played_category(resolved, context.items), ("top_n", "played_category")
    columns = context.columns or AFFINITY_COLUMNS
    # Staged: every rail, the trace and the log start from the enriched requests.
    ready = stage(
        candidates.attach_player(
            resolved, context.affinity, context.behavior, context.categories, context.policies, recent, columns
        ),
        "requests",
    )
    assembled = candidates.assemble(
        ready, context.market, norm_scope, columns, carry=carry, catalog=catalog
    )
    scored = scorer(candidates.kept(assembled))
    longest = rails.longest_rail(requests)
    additive = item_part is not None and longest > 0
    if additive and norm_scope == "eligible":
        raise ValueError("with norm_scope 'eligible' the order of items depends on the request")

    def reachable() -> DataFrame:
        most = candidates.catalog_top(catalog) if norm_scope == "catalog" else None
        heads = candidates.heads(context.market, item_part, max(longest, rails.MAX_PER_CATEGORY), most)
        few = candidates.assemble(
            ready, context.market, norm_scope, columns, carry=carry, catalog=catalog, shown=stage(heads, "heads")
        )
        return scorer(candidates.kept(few))

    def contenders() -> DataFrame:
        if longest <= 0:
            return scored
        floors = rails.floors(stage(rails.bests(scored, longest), "bests"), longest)
        again = candidates.assemble(
            ready, context.market, norm_scope, columns, carry=carry, catalog=catalog, floors=floors
        )
        return stage(rails.contenders(scorer(candidates.kept(again))), "contenders")

    return Recommendations(
        requests=ready,
        market=context.market,
        candidates=assembled,
        scored=scored,
        decisions=traces.decisions(ready, context.market),
        inference=traces.inference_rows(scored, instant(generated_at)),
        model_version=model_version,
        generated_at=generated_at,
        longest=longest,
        find_ranked=reachable if additive else contenders,
        latency=latency,
    )


def rules_long(decided: DataFrame) -> DataFrame:
    """The rules applied to each request as rows (request, rule, value)."""
    rules = (
        "market_game_blocks",
        "market_category_exclusions",
        "player_category_exclusions",
        "player_subvertical_exclusions",
    )

    def entries_of(rule: str):
        return F.transform(
            F.col(f"rules_applied.{rule}"),
            lambda v: F.struct(F.lit(rule).alias("rule"), v.cast("string").alias("value")),
        )

    entries = F.flatten(F.array(*[entries_of(rule) for rule in rules]))
    return decided.select("request_id", F.explode(entries).alias("e")).select("request_id", "e.rule", "e.value")
