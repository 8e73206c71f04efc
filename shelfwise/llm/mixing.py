"""Mixing sources to target weights: hierarchical budgets over domain, language and source.

A token budget flows down the tree in proportion to the weights of the children that exist. A child gets no more than its
texts can give in the allowed epochs; what it cannot take is shared among its siblings, and only what a whole family
cannot take goes to the parents' siblings. Each leaf then takes whole seeded epochs and, from the next one, the longest
prefix of its seeded order that fits. All of it is DataFrame expressions; prefix sums are taken in two levels (hash slices
of a leaf, then rows of a slice), so a leaf with a third of all rows is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, norm_text, small

LEVELS = ("domain", "language", "origin")
#: Production parameters of the op6 query: share of all tokens to select, epochs, seed, and relative weights.
SHARE, EPOCHS, SEED = 0.5, 2, 20
DOMAINS = {"web": [f"src{i}" for i in range(10)], "curated": [f"src{i}" for i in range(10, 20)]}
WEIGHTS = {"domain": {"web": 0.5, "curated": 0.5}, "language": {"en": 0.5, "de": 0.25, "fr": 0.125, "es": 0.125}}
OTHER = 0.0625


def count_words(text) -> F.Column:
    """Words of a text: maximal runs of anything but ASCII white space; 0 for null."""
    t = F.trim(norm_text(text))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def _choice(col: F.Column, weights: dict[str, float], other: float) -> F.Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(col == name, F.lit(float(w))).otherwise(out)
    return out


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (parent columns, name, cap, weight, budget of the parent) with `budget` replaced by each child's own.

    Water filling: with children in the order of cap / weight, a child is filled to its cap if the level at which it fills
    costs no more than the parent's budget; the rest share what is left by weight. Weights must be positive.
    """
    family = Window.partitionBy(*parent)
    ordered = family.orderBy(F.col("cap") / F.col("weight"), name)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cost = F.sum("cap").over(so_far) + F.col("cap") / F.col("weight") * (F.sum("weight").over(family) - F.sum("weight").over(so_far))
    out = children.withColumn("_full", cost <= F.col("budget"))
    spent = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(family)
    share = F.sum(F.when(F.col("_full"), F.lit(0.0)).otherwise(F.col("weight"))).over(family)
    own = F.when(F.col("_full"), F.col("cap").cast("double")).otherwise((F.col("budget") - spent) * F.col("weight") / share)
    return out.withColumn("_own", own).withColumn("budget", F.col("_own")).drop("_full", "_own")


def leaf_budgets(leaves: DataFrame, share: float, epochs: int, weights: dict[str, dict[str, float]], other: float = OTHER) -> DataFrame:
    """leaves (domain, language, origin, tokens) with `quota`, a whole number of tokens, at most epochs * tokens each."""
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = caps.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = F.lit(float(int(total * share)))
    now = None
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        here = caps.groupBy(*parent, level).agg(F.sum("cap").alias("cap")).withColumn("weight", _choice(F.col(level), weights.get(level, {}), other if level in weights else 1.0))
        here = here.withColumn("_root", F.lit(0)).withColumn("budget", budget) if now is None else here.join(now, parent)
        now = fill(here, parent or ["_root"], level).select(*parent, level, "budget")
    return leaves.join(now, list(LEVELS)).select(*LEVELS, "tokens", F.floor(F.least(F.col("budget"), F.col("tokens") * epochs)).cast("long").alias("quota"))


def mix(docs: DataFrame, domains: dict[str, list[str]], weights: dict[str, dict[str, float]], share: float, epochs: int, seed: int, other: float = OTHER,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, domain, language, origin, n_tokens, quota (of the leaf), epochs_taken, columns `keep`.

    epochs_taken is how many times the row is selected, 0 for not. Null languages and sources are names of their own
    ("?"); sources in no domain are in domain "other"; names without a weight get `other`. Rows without words are selected
    with their leaf's whole epochs and where the prefix passes them. Rows of equal id are ordered by size, then by `keep`. Other columns
    are not read. An empty table gives no rows. Of a text only the number of its words is used, counted over the whole, so
    length does not matter; a text that does not fit into what is left of the quota ends the prefix.
    """
    origin = F.coalesce(F.col(source_col), F.lit("?"))
    domain = F.lit("other")
    for name, sources in domains.items():
        domain = F.when(origin.isin(sources), F.lit(name)).otherwise(domain)
    rows = docs.select(F.col(id_col).alias("id"), domain.alias("domain"), F.coalesce(F.col(lang_col), F.lit("?")).alias("language"), origin.alias("origin"), count_words(F.col(text_col)).alias("n_tokens"), *keep)
    rows = materialize(rows, "words")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = materialize(leaf_budgets(leaves, share, epochs, weights, other), "budgets")
    n = budgets.count()
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("quota") / F.greatest("tokens", F.lit(1))), F.lit(epochs))).otherwise(0).cast("long")
    joined = rows.join(small(budgets, n, 100), list(LEVELS)).withColumn("whole", whole).withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens"))
    joined = joined.withColumn("order", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("?"))).cast("binary")))
    joined = joined.withColumn("slice", F.substring("order", 1, 3))
    sums = joined.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("held"))
    before = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sums.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held"), "slices")
    running = Window.partitionBy(*LEVELS, "slice").orderBy("order", "id", "n_tokens", *keep).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = joined.withColumn("run", F.sum("n_tokens").over(running)).join(small(starts, n * 4096, 80), [*LEVELS, "slice"])
    taken = F.col("whole") + F.when((F.col("whole") < epochs) & (F.col("start") + F.col("run") <= F.col("rest")), 1).otherwise(0)
    return placed.select(F.col("id").alias(id_col), *LEVELS, "n_tokens", "quota", taken.cast("int").alias("epochs_taken"), *keep)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), DOMAINS, WEIGHTS, SHARE, EPOCHS, SEED)


def _fill_sql(depth: int) -> str:
    parent, level = list(LEVELS[:depth]), LEVELS[depth]
    weight = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items())
    weight = f"CASE {level} {weight} ELSE {OTHER} END" if weight else "1.0"
    by = ("PARTITION BY " + ", ".join(parent)) if parent else ""
    cols = "".join(f"{p}, " for p in parent)
    up = f"JOIN f{depth - 1} USING ({', '.join(parent)})" if parent else "CROSS JOIN total"
    return f"""
c{depth} AS (SELECT {cols}{level}, sum(tokens) * {EPOCHS} AS cap, CAST({weight} AS DOUBLE) AS weight FROM leaves GROUP BY {cols}{level}),
k{depth} AS (SELECT c.*, budget, sum(cap) OVER o + cap / weight * (sum(weight) OVER (w) - sum(weight) OVER o) <= budget AS filled FROM c{depth} c {up}
  WINDOW w AS ({by}), o AS ({by} ORDER BY cap / weight, {level} ROWS UNBOUNDED PRECEDING)),
f{depth} AS (SELECT {cols}{level}, CASE WHEN filled THEN CAST(cap AS DOUBLE)
  ELSE (budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER w) * weight / sum(CASE WHEN filled THEN 0.0 ELSE weight END) OVER w END AS budget FROM k{depth} WINDOW w AS ({by})),"""


OP6_SQL = rf"""
WITH words AS (SELECT doc_id, CASE {" ".join(f"WHEN source IN ({', '.join(map(repr, v))}) THEN '{k}'" for k, v in DOMAINS.items())} ELSE 'other' END AS domain,
    coalesce(lang, '?') AS language, coalesce(source, '?') AS origin, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, language, origin, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM words GROUP BY ALL),
total AS (SELECT floor(sum(tokens) * {SHARE}) AS budget FROM leaves),{"".join(map(_fill_sql, range(3)))}
quotas AS (SELECT *, least(CAST(floor(least(budget, tokens * {EPOCHS})) AS BIGINT) // greatest(tokens, 1), {EPOCHS}) AS whole, CAST(floor(least(budget, tokens * {EPOCHS})) AS BIGINT) AS quota
  FROM leaves JOIN f2 USING (domain, language, origin)),
ranked AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY md5('{SEED}/' || whole || '/' || coalesce(CAST(doc_id AS VARCHAR), '?')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS run
  FROM words JOIN quotas USING (domain, language, origin))
SELECT doc_id, domain, language, origin, n_tokens, quota, CAST(whole + CASE WHEN whole < {EPOCHS} AND run <= quota - whole * tokens THEN 1 ELSE 0 END AS INTEGER) AS epochs_taken FROM ranked
"""
