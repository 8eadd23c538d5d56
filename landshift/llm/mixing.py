"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed to cells of source, language and topic. Sweeps scale the cells
until their source, language and topic sums meet the targets; a cell's fitted tokens over
its real ones, scaled to a budget of tokens and at most one, is the probability with which
each of its documents is taken. The draw hashes the document, so it repeats on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from landshift.llm.storage import discard, store

DIMENSIONS = ("source", "language", "topic")
#: A target share is the observed share to this power, scaled to one: 1 keeps the mix, 0 makes it even.
TEMPER = {"source": 0.6, "language": 0.7, "topic": 0.8}
TOLERANCE = 1e-4  # largest relative miss of a target that ends the sweeps
SWEEPS = 25
KEPT = 0.2  # least share of the tokens that is kept, whatever the rarest cell holds
SEED = 17
MISSING = "(none)"


def form(text: Column) -> Column:
    """Default topic: the form of a text."""
    return (
        F.when(F.length(F.trim(text)) == 0, "empty").when(text.contains(" | "), "table")
        .when(F.lower(text).contains("licen"), "notice").when((F.upper(text) == text) & (F.lower(text) != text), "capitals")
        .otherwise("prose")
    )


def _described(source_col: str, lang_col: str, topic: Column | None, id_col: str, text_col: str, seed: int) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = {"source": F.col(source_col).cast("string"), "language": F.col(lang_col).cast("string"), "topic": form(text) if topic is None else topic.cast("string")}
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 11) / F.lit(float(1 << 53))
    return {
        **{k: F.coalesce(v, F.lit(MISSING)) for k, v in named.items()},
        "n_tokens": F.regexp_count(text, F.lit(r"\S+")).cast("bigint"), "draw": draw,
    }


def tempered_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, target): shares of the observed tokens to a power, scaled to one."""
    seen = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("part"))
    total = seen.agg(F.sum("part")).first()[0]
    return seen.select(dimension, (F.col("part") / F.lit(total or 1.0)).alias("target"))


def _scaled(cells: DataFrame, dimension: str, targets: DataFrame) -> DataFrame:
    sums = cells.groupBy(dimension).agg(F.sum("fitted").alias("_sum")).join(targets, dimension)
    factor = F.when(F.col("_sum") > 0, F.col("target") / F.col("_sum")).otherwise(0.0)
    return cells.join(sums.select(dimension, factor.alias("_factor")), dimension).withColumn("fitted", F.col("fitted") * F.col("_factor")).drop("_factor")


def _miss(cells: DataFrame, targets: dict[str, DataFrame]) -> float:
    worst = 0.0
    for dimension, target in targets.items():
        sums = cells.groupBy(dimension).agg(F.sum("fitted").alias("_sum")).join(target, dimension)
        worst = max(worst, sums.agg(F.max(F.abs(F.try_divide("_sum", "target") - 1))).first()[0] or 0.0)
    return worst


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, sweeps: int = SWEEPS) -> DataFrame:
    """`cells` (dimensions, tokens) with `fitted`, shares whose sums meet the targets as nearly as the cells allow.

    targets: for each dimension (value, target share); values without a target get
    nothing. Cells without tokens stay at zero. One row per cell crosses the network.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = store(cells.withColumn("fitted", F.col("tokens") / F.lit(float(total))))
    for _ in range(sweeps):
        after = now
        for dimension, target in targets.items():
            after = _scaled(after, dimension, target)
        after = store(after.withColumn("fitted", F.round("fitted", 15)))
        discard(now)
        now = after
        if _miss(now, targets) < tolerance:
            break
    return now


def budget_scale(fitted: DataFrame, kept: float) -> float:
    """The c at which sum(least(1, c * fitted / tokens) * tokens) is `kept` of all tokens, or of those that targets allow if these are fewer.

    Each round takes the cells that c fills as settled and solves for the others; c only
    rises, so cells stay settled. A round is one sum over the cells.
    """
    taken = F.col("fitted") > 0
    everything, allowed = (x or 0 for x in fitted.agg(F.sum("tokens"), F.sum(F.when(taken, F.col("tokens")))).first())
    wanted, scale = min(kept * everything, allowed), 0.0
    while True:
        full = taken & (F.lit(scale) * F.col("fitted") >= F.col("tokens"))
        settled, slope = (x or 0 for x in fitted.where("tokens > 0").agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("fitted")))).first())
        after = (wanted - settled) / slope if slope > 0 else scale
        if after <= scale * (1 + 1e-12):
            return scale
        scale = after


def with_probabilities(fitted: DataFrame, kept: float | None = None) -> DataFrame:
    """Probability of each cell's documents: fitted over real tokens times a scale, at most 1; 1 for cells without tokens.

    With `kept` the scale is that which takes this share of all tokens. Without, the largest
    ratio is scaled to one if that takes KEPT of the tokens or more, and else the scale is
    that for KEPT: cells that are too rare for their targets are taken whole.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens"))
    scale = budget_scale(fitted, KEPT if kept is None else kept)
    if kept is None:
        scale = max(scale, 1 / (fitted.agg(F.max(ratio)).first()[0] or 1.0))
    return fitted.withColumn("probability", F.coalesce(F.least(F.lit(1.0), F.round(ratio * F.lit(scale), 9)), F.lit(1.0)))


def calibrate(described: DataFrame, targets: dict[str, DataFrame] | None = None, kept: float | None = None) -> DataFrame:
    """(dimensions, tokens, fitted, probability) of each cell of documents with their dimensions and n_tokens."""
    cells = store(described.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    if targets is None:
        targets = {d: store(tempered_targets(cells, d, TEMPER[d])) for d in DIMENSIONS}
    return store(with_probabilities(rake(cells, targets), kept))


def mix(documents: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = SEED,
        kept: float | None = None) -> DataFrame:
    """(id, source, language, topic, n_tokens, probability, weight, selected) of every row.

    weight is the share of all fitted tokens that the document stands for; kept is the share
    of tokens to take (see `with_probabilities`). A null source,
    language or topic is a value of its own; null and empty texts have no tokens and
    are always taken; repeated rows share their draw; an empty table gives an empty result.
    """
    columns = _described(source_col, lang_col, topic, id_col, text_col, seed)
    rows = store(documents.select(F.col(id_col).alias("_id"), *[c.alias(k) for k, c in columns.items()]))
    cells = calibrate(rows, targets, kept)
    share = F.when(F.col("tokens") > 0, F.col("fitted") * F.col("n_tokens") / F.col("tokens")).otherwise(0.0)
    return rows.join(cells, list(DIMENSIONS)).select(
        F.col("_id").alias(id_col), *DIMENSIONS, "n_tokens", "probability", share.alias("weight"),
        (F.col("draw") < F.col("probability")).alias("selected"),
    )


def sample_documents(documents: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, id_col: str = "doc_id",
                     text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = SEED,
                     kept: float | None = None) -> DataFrame:
    """The rows of `documents`, all columns, that `mix` selects."""
    columns = _described(source_col, lang_col, topic, id_col, text_col, seed)
    described = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(documents.columns)], *[c.alias(f"_{k}") for k, c in columns.items()])
    cells = calibrate(documents.select(*[c.alias(k) for k, c in columns.items() if k != "draw"]), targets, kept)
    cells = cells.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], F.col("probability").alias("_probability"))
    out = described.join(cells, [f"_{d}" for d in DIMENSIONS]).where(F.col("_draw") < F.col("_probability"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(documents.columns)])
