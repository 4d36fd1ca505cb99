"""Chat formatting with cumulative-snapshot collapse.

A log often holds a conversation many times: after two turns, after four, whole.
Each turn adds its hash, with its place in the conversation, to a rolling prefix hash;
a conversation whose hash is the prefix hash of a longer one (or of an equal one with a
smaller id) is dropped by an anti-join against one row for each prefix, and the
rest are rendered. Turn numbers only give the order: a copy that counts from 1
instead of 0 is the same conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation that one task numbers and hashes.
SEGMENT = 1024
#: A mark of the template inside a text, with the backslashes put before it.
MARK = r"<(\\*)\|im_(start|end)\|>"


def _turns(log: DataFrame) -> DataFrame:
    """Distinct turns: conv_id, segment, turn, h1, h2 (xor of the hashes of the rows of a turn)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = [F.col("role").isNull(), F.col("text").isNull()]
    rows = log.select("conv_id", "turn", F.xxhash64(*told, role, F.lit("\x1f"), text).alias("h1"), F.xxhash64(F.lit("second"), text, F.lit("\x1e"), role, *told).alias("h2")).distinct()
    segment = F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62)))
    return rows.groupBy("conv_id", "turn").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")).withColumn("segment", segment)


def prefixes(log: DataFrame) -> DataFrame:
    """conv_id, k (turns so far), h1, h2 (rolling hashes of those), n (turns in all)."""
    turns, conv = _turns(log), Window.partitionBy("conv_id")
    before = conv.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "segment").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    counts = turns.groupBy("conv_id", "segment").agg(F.count("*").alias("c"))
    counts = counts.select("conv_id", "segment", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c"), F.sum("c").over(conv).alias("n"))
    # a turn's place: those of the segments before, and its number in its own
    placed = turns.withColumn("i", F.count("*").over(inside)).join(counts, ["conv_id", "segment"]).withColumn("k", F.col("c") + F.col("i"))
    hashed = placed.select("conv_id", "segment", "turn", "k", "n", F.xxhash64("k", "h1").alias("h1"), F.xxhash64("h2", "k").alias("h2"))
    sums = hashed.groupBy("conv_id", "segment").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    sums = sums.select("conv_id", "segment", F.coalesce(F.bit_xor("s1").over(before), F.lit(0)).alias("s1"), F.coalesce(F.bit_xor("s2").over(before), F.lit(0)).alias("s2"))
    rolled = hashed.withColumn("r1", F.bit_xor("h1").over(inside)).withColumn("r2", F.bit_xor("h2").over(inside)).join(sums, ["conv_id", "segment"])
    return rolled.select("conv_id", "k", F.col("s1").bitwiseXOR(F.col("r1")).alias("h1"), F.col("s2").bitwiseXOR(F.col("r2")).alias("h2"), "n")


def maximal(log: DataFrame) -> DataFrame:
    """conv_id and n of the conversations that are no prefix of another (of equal ones, the smallest id)."""
    all_ = prefixes(log)
    whole = all_.where("k = n").select("conv_id", "k", "h1", "h2")
    best = all_.groupBy(F.col("k").alias("bk"), F.col("h1").alias("b1"), F.col("h2").alias("b2")).agg(F.max("n").alias("longest"), F.min(F.when(F.col("k") == F.col("n"), F.col("conv_id"))).alias("least"))
    same = (F.col("k") == F.col("bk")) & (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2"))
    return whole.join(best, same & ((F.col("longest") > F.col("k")) | (F.col("least") < F.col("conv_id"))), "left_anti").select("conv_id", F.col("k").alias("n"))


def escape(text: Column) -> Column:
    """Marks of the template in a text get a backslash more, so that a rendered chat can be parsed back."""
    return F.regexp_replace(text, MARK, r"<\\$1|im_$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|im_(start|end)\|>", "<$1|im_$2|>")


def render(role: Column, text: Column) -> Column:
    """One turn in the template's form."""
    return F.concat(F.lit("<|im_start|>"), escape(F.coalesce(role, F.lit(""))), F.lit("\n"), escape(F.coalesce(text, F.lit(""))), F.lit("<|im_end|>"))


def format_chats(log: DataFrame) -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, text; one row for each.

    Turns are in the order of their number; a null number comes first. Rows that
    are equal in conv_id, turn, role and text count once; different rows of one turn
    number are one turn, rendered in the order of role and text. Null role or text is
    rendered as empty, but isn't equal to an empty one. Rows without conv_id are no
    conversation. Marks of the template inside a text are escaped by a backslash. An
    empty table gives no rows. Other columns are ignored.
    """
    log = log.where(F.col("conv_id").isNotNull()).select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = log.join(maximal(log), "conv_id").distinct()
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("t"), F.col("role"), F.col("text"))
    made = rows.groupBy("conv_id", F.col("n").alias("n_turns")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return made.select("conv_id", "n_turns", F.array_join(F.transform("turns", lambda t: render(t["role"], t["text"])), "\n").alias("text"))


def oracle_sql() -> str:
    escaped = lambda c: f"regexp_replace(coalesce({c}, ''), '<(\\\\*)\\|im_(start|end)\\|>', '<\\\\\\1|im_\\2|>', 'g')"
    return f"""
with t as (select distinct conv_id, turn::bigint turn, role, text from conversations where conv_id is not null),
g as (select conv_id, turn, list(struct_pack(r := role, x := text) order by role nulls first, text nulls first) said from t group by all),
c as (select conv_id, list(said order by turn nulls first) turns, count(*) n from g group by 1),
p as (select conv_id, n, k, list_slice(turns, 1, k) pre from c, unnest(generate_series(1, n)) u(k)),
b as (select k, pre, max(n) longest, min(case when k = n then conv_id end) least from p group by 1, 2),
m as (select c.conv_id, c.n from c join b on c.n = b.k and c.turns = b.pre where b.longest = c.n and b.least = c.conv_id)
select conv_id, n::bigint n_turns,
       string_agg('<|im_start|>' || {escaped('role')} || chr(10) || {escaped('text')} || '<|im_end|>', chr(10) order by turn nulls first, role nulls first, text nulls first) as text
from t join m using (conv_id) group by 1, 2"""
