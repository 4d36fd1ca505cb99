"""Mixing sources to target weights, by hierarchical budgets.

A token budget goes down a tree of domain, language and source. At each node the
children get shares by weight; a child that can't use its share keeps what it has
(its tokens times the epochs allowed) and its siblings take the rest, so a
shortage only reaches a higher level when a whole subtree is short. Each leaf then
takes whole epochs and a token prefix of the next, in a seeded order.

Leaves may hold a third of all rows, so prefixes aren't found by sorting a leaf:
tokens are summed by ranges of the seeded hash, and only the range in which the
prefix ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
#: Hash ranges of a leaf; the order in a range is found in one task.
RANGES = 4096


def _words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def _draw(seed: int, epoch: Column, key: Column) -> Column:
    """The place of a row in an epoch: 52 bits of md5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _fill(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Water-filling among siblings: nodes(by..., weight, cap, have) gets column budget.

    In ascending order of cap / weight, a child is full if its share of what the
    fuller ones left is more than its cap; the others share the rest by weight.
    """
    up = Window.partitionBy(*by[:-1]) if by[:-1] else Window.partitionBy(F.lit(0))
    order = up.orderBy((F.col("cap") / F.col("weight")).asc(), F.col(by[-1]))
    n = nodes.withColumn("_used", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    n = n.withColumn("_rest", F.col("have") - F.coalesce("_used", F.lit(0))).withColumn("_full", F.col("cap").cast("decimal(38,0)") * F.col("_left") <= F.col("_rest").cast("decimal(38,0)") * F.col("weight"))
    # the full ones come first; from the first that isn't on, rest and weights stay the same
    n = n.withColumn("_rest", F.max(F.when(~F.col("_full"), F.struct(-F.row_number().over(order), "_rest", "_left"))).over(up))
    share = F.expr("cast(cast(_rest._rest as decimal(20,0)) * weight div _rest._left as bigint)")
    return n.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(share)).drop("_used", "_left", "_rest", "_full", "have")


def budgets(leaves: DataFrame, total: int | None, weights: dict[str, dict[str, int]], epochs: int, percent: int = 100) -> DataFrame:
    """leaves(domain, lang, source, tokens) with column budget; weights: level -> name -> positive integer, 1 if not listed.

    total is in tokens; without it the budget is `percent` of all tokens.
    """

    def weight(level: str) -> Column:
        w = F.lit(1)
        for name, x in weights.get(level, {}).items():
            w = F.when(F.col(level) == name, F.lit(int(x))).otherwise(w)
        return w.cast("long")

    tree = leaves.withColumn("cap", F.col("tokens") * epochs)
    given = None
    for depth in range(1, len(LEVELS) + 1):
        by = list(LEVELS[:depth])
        nodes = tree.groupBy(*by).agg(F.sum("cap").alias("cap")).withColumn("weight", weight(by[-1]))
        if given is None:
            whole = F.sum("cap").over(Window.partitionBy(F.lit(0)))  # a row for each domain
            nodes = nodes.withColumn("have", F.lit(int(total)).cast("long") if total is not None else F.floor(whole.cast("decimal(30,0)") * percent / (100 * epochs)).cast("long"))
        else:
            nodes = nodes.join(given, by[:-1]).withColumn("have", F.col("budget")).drop("budget")
        given = _fill(nodes, by).select(*by, "budget")
    return leaves.join(given, list(LEVELS))


def mix(docs: DataFrame, domain: Column, total: int | None, weights: dict[str, dict[str, int]], epochs: int = 2, seed: int = 17, keep: bool = False, percent: int = 100) -> DataFrame:
    """Selected documents with their number of copies: doc_id, domain, lang, source, n_tokens, copies (keep: docs' columns and copies).

    total is the token budget (None: `percent` of all tokens); at most `epochs` copies of a document are taken. A
    leaf's next epoch is a prefix in seeded order whose tokens don't exceed the
    leaf's rest. Tokens are words between ASCII white space. Null domain, lang and
    source count as "". Rows of one id share their place (null ids too) and go
    together. Texts without words cost nothing and go with their place. An empty
    table gives none. Other columns are ignored (keep: pass through, but for an older copies).
    """
    leaf_of = {"_domain": domain, "_lang": F.col("lang"), "_source": F.col("source")}
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "copies")).alias("_row")] * keep
    rows = docs.select(*row, F.col("doc_id").alias("_id"), *(F.coalesce(c, F.lit("")).alias(k) for k, c in leaf_of.items()), _words(F.col("text")).alias("_tokens"))
    named = [F.col("_" + c).alias(c) for c in LEVELS]
    leaves = rows.groupBy(*named).agg(F.sum("_tokens").alias("tokens"))
    plan = budgets(leaves, total, weights, epochs, percent)
    plan = plan.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("long"))
    plan = plan.select(*(F.col(c).alias("_" + c) for c in LEVELS), "full", (F.col("budget") - F.col("full") * F.col("tokens")).alias("rest"))
    leaf = ["_" + c for c in LEVELS]
    # the tree is small beside the rows, but nothing bounds it: Spark decides at run time how to join
    placed = rows.join(plan, leaf).withColumn("_at", _draw(seed, F.col("full"), F.col("_id")))
    placed = placed.withColumn("_range", F.shiftright("_at", 52 - (RANGES.bit_length() - 1)).cast("int"))
    sums = placed.groupBy(*leaf, "_range", "rest").agg(F.sum("_tokens").alias("sum"))
    run = Window.partitionBy(*leaf).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("to", F.sum("sum").over(run)).withColumn("from", F.col("to") - F.col("sum"))
    # the range in which the prefix ends: the first whose total goes beyond the rest
    ends = sums.where("to > rest").groupBy(*leaf).agg(F.min(F.struct("_range", "from")).alias("e")).select(*leaf, F.col("e._range").alias("_end"), F.col("e.from").alias("_before"))
    ended = placed.join(ends, leaf, "left")
    inside = ended.where(F.col("_range") == F.col("_end")).groupBy(*leaf, "_at", "_before", "rest").agg(F.sum("_tokens").alias("t"))
    sofar = Window.partitionBy(*leaf).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("to", F.col("_before") + F.sum("t").over(sofar)).where("to <= rest").groupBy(*leaf).agg(F.max("_at").alias("_last"))
    chosen = ended.join(last, leaf, "left")
    part = F.col("_end").isNull() & (F.col("rest") > 0) | (F.col("_range") < F.col("_end")) | (F.col("_range") == F.col("_end")) & (F.col("_at") <= F.coalesce("_last", F.lit(-1)))
    out = chosen.withColumn("copies", F.col("full") + F.when(part, 1).otherwise(0)).where("copies > 0")
    if keep:
        return out.select("_row.*", "copies")
    return out.select(F.col("_id").alias("doc_id"), *(F.col("_" + c).alias(c) for c in LEVELS), F.col("_tokens").alias("n_tokens"), "copies")


def oracle_sql(domain: str, total: int | None, weights: dict[str, dict[str, int]], epochs: int = 2, seed: int = 17, percent: int = 100) -> str:
    """The same selection in DuckDB; domain is a SQL expression."""

    def case(level: str) -> str:
        found = " ".join(f"when {level} = '{k}' then {v}" for k, v in weights.get(level, {}).items())
        return f"(case {found} else 1 end)::hugeint" if found else "1::hugeint"

    steps = []
    budget = f"(sum(cap) over () * {percent} // {100 * epochs})::hugeint" if total is None else f"{total}::hugeint"
    for depth in range(1, 4):
        by = ", ".join(LEVELS[:depth])
        over = f"partition by {', '.join(LEVELS[: depth - 1])}" if depth > 1 else ""
        join = f"join b{depth - 1} using ({', '.join(LEVELS[: depth - 1])})" if depth > 1 else ""
        have = f"b{depth - 1}.budget" if depth > 1 else budget
        steps.append(f"""
n{depth} as (select {by}, cap, weight, {have} have from (select {by}, sum(tokens * {epochs})::hugeint cap, any_value({case(LEVELS[depth - 1])}) weight from leaves group by {by}) {join}),
o{depth} as (select *, row_number() over w rn, have - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0)::hugeint rest, (sum(weight) over (w rows between current row and unbounded following))::hugeint lft
             from n{depth} window w as ({over} order by cap::double / weight::double, {LEVELS[depth - 1]})),
f{depth} as (select *, cap * lft <= rest * weight as is_full from o{depth}),
b{depth} as (select {by}, case when is_full then cap else (first_value(rest) over v * weight) // first_value(lft) over v end budget
             from f{depth} window v as ({over} order by is_full, rn rows between unbounded preceding and unbounded following))""")
    return f"""
with rows_ as (select doc_id, coalesce({domain}, '') as "domain", coalesce(lang, '') as lang, coalesce(source, '') as source,
                      len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::bigint n_tokens from documents),
leaves as (select "domain", lang, source, sum(n_tokens)::bigint tokens from rows_ group by all),{','.join(steps)},
p as (select *, case when tokens > 0 then budget // tokens else 0 end as whole_epochs from leaves join b3 using ("domain", lang, source)),
a as (select r.*, whole_epochs, budget - whole_epochs * tokens rest, ('0x' || substr(md5('{seed}|' || whole_epochs || '|' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint at_
      from rows_ r join p using ("domain", lang, source)),
c as (select *, sum(n_tokens) over (partition by "domain", lang, source order by at_ range between unbounded preceding and current row) cum, sum(n_tokens) over (partition by "domain", lang, source) t from a)
select doc_id, "domain", lang, source, n_tokens, (whole_epochs + case when t > 0 and cum <= rest then 1 else 0 end)::bigint copies from c
where whole_epochs + case when t > 0 and cum <= rest then 1 else 0 end > 0"""
