"""Chat formatting after a cumulative-snapshot collapse.

Logs often keep every state of a conversation: each snapshot is a prefix of the next. Rolling hashes over turns give
every prefix of every conversation a fingerprint; a conversation whose own fingerprint is a proper prefix of another's
is dropped by an anti-join, and of equal ones the smallest id stays. What is left is rendered.

All of this is decided on fingerprints of turns, 16 bytes each; texts are moved once, to be rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import materialize, with_near

BLOCK = 256  # turns in a part of a rendering


def _print(salt: int, *cols: str) -> Column:
    parts = [F.lit(salt)]
    for c in cols:
        parts += [F.col(c).isNull(), F.coalesce(F.col(c), F.lit(""))]
    return F.xxhash64(*parts)


def _turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(_c, _t, _r, _x, _h1, _h2): turns with two hashes of role and text."""
    rows = turns.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), F.col(role).alias("_r"), F.col(text).alias("_x"))
    return rows.withColumn("_h1", _print(1, "_r", "_x")).withColumn("_h2", _print(2, "_x", "_r"))


def placed_turns(rows: DataFrame) -> DataFrame:
    """(_c, _t, _h1, _h2, _pos, _n, _p1, _p2, _f1, _f2): turns with place, number of turns, prefix and full fingerprints.

    Turns are dealt by ranges of conversation, number, role and text; text only where turns share a number. Places and
    fingerprints run within a range; a conversation that ranges cut is carried on by the totals of its ranges. At most
    one conversation crosses from a range to the next, so these totals are fewer than twice the ranges.
    """
    named = lambda *c: [F.col(x) for x in c]
    two = F.struct("_h1", "_h2")
    shared = rows.groupBy("_c", "_t").agg(F.min(two).alias("_a"), F.max(two).alias("_b")).where("_a <> _b").select(F.xxhash64("_c", "_t").alias("_h"))
    slim = with_near(rows, F.xxhash64("_c", "_t"), materialize(shared), "_h").withColumn("_x", F.when(F.col("_near"), F.col("_x")))
    slim = slim.groupBy("_c", "_t", "_h1", "_h2").agg(F.first("_r").alias("_r"), F.first("_x").alias("_x"))  # repeated turns count once
    slim = base = materialize(slim.repartitionByRange("_c", "_t", "_r", "_x").withColumn("_b", F.spark_partition_id()))  # ranges stay as they are from here on
    inside = Window.partitionBy("_c", "_b").orderBy("_t", "_r", "_x")
    running, whole = inside.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("_c", "_b")
    slim = slim.withColumn("_g1", F.xxhash64(F.lit(3), "_h1", "_h2")).withColumn("_g2", F.xxhash64(F.lit(4), "_h2", "_h1"))
    slim = slim.select(
        "_c", "_t", "_h1", "_h2", "_b", "_r", "_x", "_g1", "_g2", F.row_number().over(inside).cast("long").alias("_k"), F.count(F.lit(1)).over(whole).alias("_size"),
    )
    parts = base.groupBy("_c", "_b").agg(F.count(F.lit(1)).alias("_size"))
    cut = parts.groupBy("_c").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select(F.col("_c").alias("_cc"))
    order = Window.partitionBy("_c").orderBy("_b")
    before, all_of = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_c")
    sizes = parts.join(F.broadcast(cut), F.col("_c").eqNullSafe(F.col("_cc")), "left_semi")
    sizes = sizes.select("_c", "_b", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_skip"), F.sum("_size").over(all_of).alias("_all"))
    slim = _carried(slim, sizes).withColumn("_pos", F.col("_k") + F.coalesce("_skip", F.lit(0))).withColumn("_n", F.coalesce("_all", "_size")).drop("_skip", "_all")
    # What a turn adds to a fingerprint depends on its place.
    slim = slim.withColumn("_g1", F.xxhash64("_pos", "_g1")).withColumn("_g2", F.xxhash64("_pos", "_g2"))
    slim = slim.select(
        *named("_c", "_t", "_h1", "_h2", "_b", "_pos", "_n", "_g1", "_g2"),
        *(F.bit_xor(f"_g{i}").over(running).alias(f"_p{i}") for i in (1, 2)), *(F.bit_xor(f"_g{i}").over(whole).alias(f"_f{i}") for i in (1, 2)),
    )
    sums = slim.groupBy("_c", "_b").agg(F.bit_xor("_g1").alias("_x1"), F.bit_xor("_g2").alias("_x2")).join(F.broadcast(cut), F.col("_c").eqNullSafe(F.col("_cc")), "left_semi")
    sums = sums.select(
        "_c", "_b", *(F.coalesce(F.bit_xor(f"_x{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in (1, 2)), *(F.bit_xor(f"_x{i}").over(all_of).alias(f"_e{i}") for i in (1, 2))
    )
    slim = _carried(slim, sums)
    prefix = lambda i: F.col(f"_p{i}").bitwiseXOR(F.coalesce(f"_s{i}", F.lit(0))).alias(f"_p{i}")
    return slim.select(*named("_c", "_t", "_h1", "_h2", "_pos", "_n"), prefix(1), prefix(2), *(F.coalesce(f"_e{i}", f"_f{i}").alias(f"_f{i}") for i in (1, 2)))


def _carried(rows: DataFrame, by_range: DataFrame) -> DataFrame:
    """Left join with the totals of cut conversations, fewer than twice the ranges; null ids match."""
    other = by_range.withColumnsRenamed({"_c": "_c2", "_b": "_b2"})
    return rows.join(F.broadcast(other), F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_b") == F.col("_b2")), "left").drop("_c2", "_b2")


def maximal(placed: DataFrame) -> DataFrame:
    """(_c): the conversations that are no prefix of another."""
    full = placed.where("_pos = _n").groupBy("_n", "_f1", "_f2").agg(F.min(F.struct("_c")).alias("_keep"))
    prefixes = placed.where("_pos < _n").select("_pos", "_p1", "_p2").distinct()
    return full.join(prefixes, (full._n == prefixes._pos) & (full._f1 == prefixes._p1) & (full._f2 == prefixes._p2), "left_anti").select("_keep._c")


def format_chats(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Collapse and render: (conv, part, n_turns, part_turns, rendered).

    Each turn is rendered as "<|im_start|>role\\ntext<|im_end|>\\n". A conversation comes in parts of 256 turns, which
    joined in order are its rendering; most have one, part 0. Turns go by number, then role, then text, nulls first;
    exactly repeated turns count once. Null roles and texts are rendered as empty, but differ from empty ones in the
    comparison. Turns without a conversation id form one conversation. A long text travels as a whole, at most 256 of
    them to a task. An empty table gives none. Only the four named columns are read.
    """
    rows = _turns(turns, conv, turn, role, text)
    placed = materialize(placed_turns(rows))
    kept = materialize(maximal(placed))
    line = lambda r, x: F.concat(F.lit("<|im_start|>"), F.coalesce(r, F.lit("")), F.lit("\n"), F.coalesce(x, F.lit("")), F.lit("<|im_end|>\n"))
    # Conversations of more than one part, and a few others, take the long way: their turns meet their places by hash.
    long = materialize(placed.where(f"_pos = _n AND _n > {BLOCK}").select(F.xxhash64("_c").alias("_h")))
    route = lambda df: with_near(df, F.xxhash64("_c"), long, "_h").withColumn("_near", F.col("_near") | F.col("_c").isNull())
    routed, kept = route(rows), route(kept).withColumnRenamed("_c", "_kept")
    # The others are at most BLOCK turns: sorted and rendered where they meet.
    whole = routed.where("NOT _near").select("_c", "_t", "_r", "_x").join(kept.where("NOT _near"), F.col("_c") == F.col("_kept"), "left_semi")
    whole = whole.groupBy("_c").agg(F.sort_array(F.collect_set(F.struct(*(F.struct(F.col(c).isNotNull().alias("k"), F.coalesce(c, d).alias("v")).alias(c) for c, d in (("_t", F.lit(0)), ("_r", F.lit("")), ("_x", F.lit(""))))))).alias("_l"))
    whole = whole.select(
        "_c", F.lit(0).cast("long").alias("part"), F.size("_l").cast("long").alias("n_turns"), F.size("_l").cast("long").alias("part_turns"),
        F.array_join(F.transform("_l", lambda e: line(e["_r"]["v"], e["_x"]["v"])), "").alias("rendered"),
    )
    near = placed.join(kept.where("_near"), F.col("_c").eqNullSafe(F.col("_kept")), "left_semi").select("_c", "_t", "_h1", "_h2", "_pos", "_n").withColumnsRenamed({c: f"_o{c}" for c in ("_c", "_t", "_h1", "_h2")})
    texts = routed.where("_near").join(near, F.col("_c").eqNullSafe(F.col("_o_c")) & F.col("_t").eqNullSafe(F.col("_o_t")) & (F.col("_h1") == F.col("_o_h1")) & (F.col("_h2") == F.col("_o_h2")))
    texts = texts.select("_c", "_n", "_pos", F.floor((F.col("_pos") - 1) / BLOCK).alias("part"), line(F.col("_r"), F.col("_x")).alias("_line"))
    lines = F.sort_array(F.collect_set(F.struct("_pos", "_line")))  # at most BLOCK; a repeated turn is there once
    cut = texts.groupBy("_c", "part").agg(F.first("_n").alias("n_turns"), lines.alias("_l"))
    cut = cut.select("_c", "part", "n_turns", F.size("_l").cast("long").alias("part_turns"), F.array_join(F.transform("_l", lambda e: e["_line"]), "").alias("rendered"))
    return whole.unionByName(cut).withColumnRenamed("_c", conv)


ORACLE = f"""
    WITH a AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
    b AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
            string_agg(coalesce('r' || role, '') || chr(31) || coalesce('t' || text, ''), chr(30)) OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
        FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
    f AS (SELECT n, prefix, min(conv_id) AS conv_id FROM b WHERE pos = n GROUP BY n, prefix),
    k AS (SELECT conv_id FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.pos = f.n AND b.n > f.n AND b.prefix = f.prefix))
    SELECT conv_id, CAST((pos - 1) // {BLOCK} AS BIGINT) AS part, CAST(any_value(n) AS BIGINT) AS n_turns, count(*) AS part_turns,
        string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
    FROM b JOIN k USING (conv_id) GROUP BY conv_id, part"""
