"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders. Windows of the canonical words are joined by hash; where windows
of a benchmark item meet a document, the values that fill the placeholders must replace one another consistently. So a
question is found again with other numbers or names in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import materialize, with_near

#: Windows of so many words. A shorter item is one window.
WINDOW = 8
#: An item is found in a document that holds so many of its windows.
COVERAGE = 0.5
#: The least number of literal words in a window.
LITERAL = 3
#: Windows of the benchmark are sent to all tasks up to so many bytes, else joined by a shuffle.
BROADCAST = 64 << 20

# Units of measure.
UNITS = (
    "kg g mg km m cm mm mi ft l ml lb lbs oz h hr hrs hour hours min minute minutes s sec second seconds day days week weeks month months "
    "year years mph usd eur dollar dollars euro euros cent cents percent meter meters metre metres kilometer kilometers kilometre "
    "kilometres mile miles liter liters litre litres gram grams kilogram kilograms pound pounds degree degrees"
).split()

# Words that begin a sentence and are no names.
OPENERS = (
    "a about after all also although an and any are as at because before both but by can could did do does during each either every few find for from give given had has have he her "
    "his how however i if in is it its let many may most my no not now of on once one or other our she should since so some such than that the their then there these they this those "
    "though to under until was we were what when where whether which while who whose why will with would you your"
).split()

NUMBER = r"\p{N}+(?:[.,:/]\p{N}+)*"


def canonical(rows: DataFrame, text: str) -> DataFrame:
    """Adds _raw, _t, _u: raw words, template words, template words with names that begin sentences; of equal lengths.

    A name is a word with a capital first letter that does not begin a sentence; numbers and the units after them are
    placeholders too. All else is lower-cased. A capitalised word that begins a sentence may be a name or not: the third
    array has a placeholder for it, unless it is one of OPENERS.

    Each pass over a text has a step of its own, and the arrays leave them as one generated value: conditions on the
    arrays would else be moved before the passes, which would then run twice.
    """
    kept = [c for c in rows.columns if c != text]
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), "¤‹›", "   ")
    steps = rows.select(*kept, F.regexp_replace(plain, r"(^|[.!?\n][\s\"']*)(\p{Lu})", "$1¤$2").alias("_marked"))
    t = F.regexp_replace("_marked", r"([^¤\p{L}])\p{Lu}\p{Ll}\p{L}*", "$1‹name›")
    t = F.regexp_replace(t, NUMBER, "‹num›")
    t = F.regexp_replace(t, rf"(?i)(‹num›\s*)(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})([^\p{{L}}]|$)", "$1‹unit›$2")
    steps = steps.select(*kept, F.regexp_extract_all("_marked", F.lit(rf"{NUMBER}|¤?\p{{L}}+"), F.lit(0)).alias("_raw"), t.alias("_typed"))
    split = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"‹\p{L}+›|\p{L}+"), F.lit(0))
    u = F.regexp_replace("_typed", rf"¤(?!(?i:{'|'.join(OPENERS)})(?!\p{{L}}))\p{{Lu}}\p{{Ll}}\p{{L}}*", "‹name›")
    one = F.struct(F.col("_raw"), split(F.col("_typed")).alias("_t"), split(u).alias("_u"))
    return steps.select(*kept, F.explode(F.array(one)).alias("_words")).select(*kept, "_words._raw", "_words._t", "_words._u")


def _windows(rows: DataFrame, n: int) -> DataFrame:
    """One row for each window of n words, with its place and its hash; a second one (_form 1) where a name may begin a
    sentence. Rows never leave generated code here."""
    rows = rows.where(F.size("_t") >= n).withColumn("_p", F.explode(F.sequence(F.lit(0), F.size("_t") - n)))
    both = [F.xxhash64(F.lit(n), *[F.col(c)[F.col("_p") + k] for k in range(n)]) for c in ("_t", "_u")]
    return rows.select("*", F.posexplode(F.array_distinct(F.array(*both))).alias("_form", "_h"))


def _exact_windows(rows: DataFrame, n: int) -> DataFrame:
    """The windows of n words as they stand, without case (_form 2)."""
    rows = rows.where(F.size("_raw") >= n).withColumn("_p", F.explode(F.sequence(F.lit(0), F.size("_raw") - n)))
    words = [F.lower(F.translate(F.col("_raw")[F.col("_p") + k], "¤", "")) for k in range(n)]
    return rows.withColumn("_form", F.lit(2)).withColumn("_h", F.xxhash64(F.lit(-n), *words))


def _short_windows(rows: DataFrame, widths: list[tuple[int, bool]]) -> DataFrame:
    """The windows of items shorter than a window or searched as they stand, of all their widths in one pass."""
    columns = rows.columns

    def hashed(words: str, at: Column, n: int, whole: bool) -> Column:
        return F.xxhash64(F.lit(-n if whole else n), *[F.col(words)[at + k] for k in range(n)])

    def made(words: str, form: int, n: int, whole: bool) -> Column:
        places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        found = F.transform(places, lambda p: F.struct(p.alias("p"), F.lit(form).alias("form"), hashed(words, p, n, whole).alias("h")))
        return F.filter(found, lambda w: w["h"] != hashed("_t", w["p"], n, whole)) if form == 1 else found

    rows = rows.withColumn("_plain", F.transform("_raw", lambda w: F.lower(F.translate(w, "¤", ""))))
    lists = [made(*kind, n, whole) for n, whole in widths for kind in ([("_plain", 2)] if whole else [("_t", 0), ("_u", 1)])]
    rows = rows.withColumn("_w", F.explode(F.concat(*lists)))
    return rows.select(*columns, F.col("_w.p").alias("_p"), F.col("_w.form").alias("_form"), F.col("_w.h").alias("_h"))


def benchmark_windows(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(_item, _n, _all, _width, _i, _form, _h, _slots): the windows of all items.

    _n counts those of an item's template, _all those of either form. Windows with too few literal words are left out;
    an item that has no others is searched as it stands, without placeholders.
    """
    rows = canonical(items.select(F.col(item).alias("_item"), F.col(text).alias("_text")), "_text").where("size(_t) > 0").dropDuplicates(["_item", "_t"])
    made = exact = None
    for n in range(1, window + 1):
        of_width = rows.where(F.size("_t") == n) if n < window else rows
        some, whole = (f(of_width, n).withColumn("_width", F.lit(n)) for f in (_windows, _exact_windows))
        made, exact = (some, whole) if made is None else (made.unionByName(some), exact.unionByName(whole))
    at = F.when(F.col("_form") == 0, F.col("_t")).otherwise(F.col("_u"))
    slots = F.filter(
        F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda k: F.struct(k.alias("o"), at[F.col("_p") + k].alias("kind"), F.translate(F.col("_raw")[F.col("_p") + k], "¤", "").alias("was"))),
        lambda s: s["kind"].startswith("‹"),
    )
    made = made.withColumn("_slots", slots).where(F.col("_width") - F.size("_slots") >= F.least(F.lit(LITERAL), F.col("_width")))
    made = materialize(made.select("_item", "_t", "_p", "_width", "_form", "_h", "_slots"))
    known = made.select("_item").distinct().withColumnRenamed("_item", "_of")
    exact = exact.join(known, F.col("_item").eqNullSafe(F.col("_of")), "left_anti").withColumn("_slots", F.filter(slots, lambda s: F.lit(False)))
    made = materialize(made.unionByName(exact.select(*made.columns)))
    counted = made.groupBy(F.col("_item").alias("_of")).agg(F.count(F.when(F.col("_form") != 1, 1)).alias("_n"), F.count_distinct("_t", "_p").alias("_all"))
    return made.join(counted, F.col("_item").eqNullSafe(F.col("_of"))).select("_item", "_n", "_all", "_width", F.col("_p").alias("_i"), "_form", "_h", "_slots")


def leaks_of_texts(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE
) -> DataFrame:
    """Pairs of texts and the benchmark items they hold: (_key, _v, _item, _n, n_hit, n_slots); _v is the text's hash.

    `n_hit` of an item's `n_windows` windows stand in the document on diagonals whose slots are consistent: one value
    in the item is replaced by one value in the document. `n_slots` counts slots compared. Null and empty texts hold
    nothing; an item without words is never found; names that begin sentences count where an item is not found without them; a null key or item id is an id like any other. Repeated rows give
    one pair. Empty tables give none. Only the named columns are read. A long text is read as a whole; its windows are
    made one by one. A coverage of just `coverage` is enough. The size of the benchmark's windows is summed up, and they
    are sent to all tasks only within a bound of bytes; otherwise places and hashes are joined by shuffle.
    """
    parts = materialize(benchmark_windows(benchmark, item, item_text, window))
    exact = F.col("_form") == 2
    widest = F.sum(F.lit(64) + 24 * F.size("_slots") + F.coalesce(F.aggregate("_slots", F.lit(0), lambda a, x: a + F.octet_length(x["kind"]) + F.octet_length(x["was"])), F.lit(0)))
    sizes = {(r._width, r.x): r.bytes for r in parts.groupBy("_width", exact.alias("x")).agg(widest.alias("bytes")).collect()}  # at most twice `window` numbers
    small = sum(sizes.values()) <= BROADCAST
    rows = canonical(docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_v"), F.col(text).alias("_text")), "_text")

    def meet(windows: DataFrame, right: DataFrame) -> DataFrame:
        """Windows of documents that stand in the benchmark, with the values of their slots."""
        right = right.withColumnRenamed("_form", "_as")
        if small:
            some = windows.join(F.broadcast(right), "_h")
        else:
            # Places and hashes are shuffled, and few of those; words are fetched for what was found.
            near = with_near(windows.select("_key", "_v", "_p", "_form", "_h"), F.col("_h"), right, "_h").where("_near").drop("_near")
            hits = materialize(near.distinct().join(right, "_h"))
            of = hits.select(F.xxhash64("_key", "_v").alias("_kv")).distinct()
            texts = with_near(rows.select("_key", "_v", "_raw"), F.xxhash64("_key", "_v"), of, "_kv").where("_near").dropDuplicates(["_key", "_v"])
            texts = texts.select(F.col("_key").alias("_tk"), F.col("_v").alias("_tv"), "_raw")
            some = hits.join(texts, F.col("_key").eqNullSafe(F.col("_tk")) & F.col("_v").eqNullSafe(F.col("_tv")))
        return some.select(
            "_key", "_v", "_item", "_n", "_all", "_i", (F.col("_p") - F.col("_i")).alias("_d"), (F.col("_form") == F.col("_as")).alias("_same"), (F.col("_form") != 1).alias("_plain"),
            F.transform("_slots", lambda s: F.struct(s["kind"].alias("kind"), s["was"].alias("was"), F.translate(F.col("_raw")[F.col("_p") + s["o"]], "¤", "").alias("now"))).alias("_slots"),
        )

    full = (F.col("_width") == window) & ~exact
    met = meet(_windows(rows, window), parts.where(full))
    if others := sorted(k for k in sizes if k != (window, False)):
        met = met.unionByName(meet(_short_windows(rows, others), parts.where(~full)))
    plain = F.col("_same") & F.col("_plain")
    gather = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    line = met.groupBy("_key", "_v", "_item", "_n", "_all", "_d").agg(
        F.collect_set(F.when(plain, F.col("_i"))).alias("_is0"), gather(F.when(plain, F.col("_slots"))).alias("_slots0"), F.collect_set("_i").alias("_is1"), gather(F.col("_slots")).alias("_slots1")
    )
    for k in "01":
        old = F.array_distinct(F.transform(f"_slots{k}", lambda s: F.struct(s["kind"].alias("kind"), s["was"].alias("was"))))
        ok = (F.size(old) == F.size(f"_slots{k}")) & (F.size(f"_is{k}") > 0)
        line = line.withColumn(f"_z{k}", F.when(ok, F.size(f"_slots{k}")).cast("long")).withColumn(f"_is{k}", F.when(ok, F.col(f"_is{k}")))
    hits = lambda k: F.size(F.array_distinct(F.flatten(F.collect_list(f"_is{k}")))).cast("long").alias(f"_hit{k}")
    found = line.groupBy("_key", "_v", "_item", "_n", "_all").agg(hits("0"), F.max("_z0").alias("_z0"), hits("1"), F.max("_z1").alias("_z1"))
    enough = lambda hit, n: (F.col(hit) > 0) & (F.col(hit) >= F.lit(coverage) * F.col(n))
    found = found.where(enough("_hit0", "_n") | enough("_hit1", "_all")).withColumn("_plain", enough("_hit0", "_n"))
    either = lambda a, b: F.when(F.col("_plain"), F.col(a)).otherwise(F.col(b))
    return found.select("_key", "_v", "_item", "_plain", either("_n", "_all").alias("_n"), either("_hit0", "_hit1").alias("n_hit"), either("_z0", "_z1").alias("n_slots"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE
) -> DataFrame:
    """Pairs of documents and the benchmark items they hold: (key, item, n_hit, n_windows, coverage, n_slots).

    Those of `leaks_of_texts`; of the texts that share a key, the best counts.
    """
    found = leaks_of_texts(docs, benchmark, key=key, text=text, item=item, item_text=item_text, window=window, coverage=coverage)
    best = found.groupBy("_key", "_item").agg(
        F.max(F.struct("_plain", "n_hit", F.col("_n").alias("n_windows"))).alias("_b"), F.coalesce(F.max(F.when(F.col("_plain"), F.col("n_slots"))), F.max("n_slots")).alias("n_slots")
    )
    best = best.select("_key", "_item", "_b.n_hit", "_b.n_windows", "n_slots")
    return best.select(F.col("_key").alias(key), F.col("_item").alias(item), "n_hit", "n_windows", (F.col("n_hit") / F.col("n_windows")).alias("coverage"), "n_slots")


def _sql_words(text: str) -> str:
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    marked = f"regexp_replace(translate(coalesce({text}, ''), '¤‹›', '   '), '(^|[.!?\\n][\\s\"'']*)(\\p{{Lu}})', '\\1¤\\2', 'g')"
    t = f"regexp_replace({marked}, '([^¤\\p{{L}}])\\p{{Lu}}\\p{{Ll}}\\p{{L}}*', '\\1‹name›', 'g')"
    t = f"regexp_replace({t}, '{NUMBER}', '‹num›', 'g')"
    t = f"regexp_replace({t}, '(?i)(‹num›\\s*)(?:{units})([^\\p{{L}}]|$)', '\\1‹unit›\\2', 'g')"
    return f"regexp_extract_all({marked}, '{NUMBER}|¤?\\p{{L}}+') AS raw, regexp_extract_all(lower({t}), '‹\\p{{L}}+›|\\p{{L}}+') AS t"


ORACLE = f"""
    WITH d AS (SELECT doc_id, {_sql_words('text')} FROM documents),
    q AS (SELECT item_id, {_sql_words('text')} FROM benchmark),
    qw AS (SELECT item_id, raw, t, least(len(t), {WINDOW}) AS n, unnest(generate_series(1, len(t) - least(len(t), {WINDOW}) + 1)) AS p FROM q WHERE len(t) > 0),
    qx AS (SELECT item_id, n, p, t[p:p+n-1] AS w, raw[p:p+n-1] AS r FROM qw WHERE len(list_filter(t[p:p+n-1], lambda x: x[1] <> '‹')) >= least({LITERAL}, n)),
    qn AS (SELECT item_id, count(*) AS n_windows FROM qx GROUP BY item_id),
    dw AS (SELECT doc_id, raw, t, n, unnest(generate_series(1, len(t) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM qx) WHERE len(t) >= n),
    dx AS (SELECT doc_id, n, p, t[p:p+n-1] AS w, raw[p:p+n-1] AS r FROM dw),
    m AS (SELECT doc_id, item_id, qx.p AS i, dx.p - qx.p AS diag, qx.w AS w, qx.r AS was, dx.r AS now FROM dx JOIN qx USING (n, w)),
    s AS (SELECT DISTINCT doc_id, item_id, diag, w[k] AS kind, was[k] AS was, now[k] AS now FROM (SELECT *, unnest(generate_series(1, len(w))) AS k FROM m) WHERE w[k][1] = '‹'),
    sc AS (SELECT doc_id, item_id, diag, count(*) AS pairs, count(DISTINCT (kind, was)) AS olds FROM s GROUP BY ALL),
    g AS (SELECT m.doc_id, m.item_id, m.i, coalesce(sc.pairs, 0) AS pairs FROM m LEFT JOIN sc USING (doc_id, item_id, diag) WHERE coalesce(pairs, 0) = coalesce(olds, 0))
    SELECT doc_id, item_id, count(DISTINCT i) AS n_hit, CAST(any_value(n_windows) AS BIGINT) AS n_windows, count(DISTINCT i) / any_value(n_windows) AS coverage, CAST(max(pairs) AS BIGINT) AS n_slots
    FROM g JOIN qn USING (item_id) GROUP BY doc_id, item_id HAVING count(DISTINCT i) >= {COVERAGE} * any_value(n_windows)"""
