"""Similar names inside a city, or over all cities (`city=None`).

Rows with the same name form (token set, or compact name) are one form with a count, so a group of copies
never yields its pairs: a pair of rows is a pair of forms plus the two row-to-form tables. Candidates come
from equi-joins on rare parts of a name; frequent parts are split over several tasks by a salt that follows
from their frequency. Lengths are part of the join keys, so rows whose lengths rule a pair out never meet.

Where a part is so common that its names make very many pairs, their edit distances are worked out together, in Arrow batches.
"""

from __future__ import annotations

import bisect
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform.functions import closeness, names
from entiform.functions.storage import settle, spread
from entiform.operators.lookups import lookup_join

CONTAINED = 0.95
#: Rows of the spread side that meet one key in one task, and tasks of a join for each core: pairs grow with the square of a key's rows.
ROWS_PER_SALT = 2_000
TASKS_PER_CORE = 8
#: Names up to this length are met by segments for each length, longer ones by grams in cells of positions.
SHORT_NAME = 24
_SLACK = 1e-9
#: Pairs of a part from which their distances are worked out together, shorter names that a task holds then, and longer ones that meet them at once.
HEAVY_PAIRS = 20_000
ROWS_HELD = 8_192
_ROWS_ASKED = 4_096
#: Parts of one name, about; each is a row.
PARTS_OF_NAME = 50


def name_forms(records: DataFrame, form: Column, city: str | None = "city", ord: str = "task_ord") -> DataFrame:
    """(ord, city_key, form): which form each row has. Without a city all rows have the empty key."""
    key = names.canonical_city(F.col(city)) if city else F.lit("")
    return records.select(F.col(ord).alias("ord"), key.alias("city_key"), form.alias("form"))


def token_form(name: Column) -> Column:
    """Distinct significant words, sorted, as one string."""
    return F.array_join(F.array_sort(F.array_distinct(names.tokens(name))), " ")


def _counted(forms: DataFrame) -> DataFrame:
    return forms.filter(F.col("form").isNotNull()).groupBy("city_key", "form").agg(
        F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def _salted(rows: DataFrame, replicate: bool) -> DataFrame:
    """Adds `salt` by the key's frequency `df`: one side is spread over the salts, the other copied to all."""
    salts = F.ceil(F.col("df") / F.lit(ROWS_PER_SALT)).cast("bigint")
    if replicate:
        return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    return rows.withColumn("salt", F.pmod(F.xxhash64("form"), salts))


def _side(rows: DataFrame, suffix: str, on: list[str], cols: tuple[str, ...]) -> DataFrame:
    return rows.select(*on, *[F.col(c).alias(f"{c}_{suffix}") for c in cols])


def _pairs(a: DataFrame, b: DataFrame, *cols: str, also: tuple[str, ...] = ()) -> DataFrame:
    on = ["city_key", "part", *also, "salt"]
    # a number of its own, since few bytes may be many pairs and would be gathered in few tasks
    tasks = TASKS_PER_CORE * a.sparkSession.sparkContext.defaultParallelism
    left, right = _side(_salted(a, True), "a", on, cols), _side(_salted(b, False), "b", on, cols)
    return left.repartition(tasks, *on).join(right.repartition(tasks, *on), on)


def _same_form(forms: DataFrame) -> DataFrame:
    copies = forms.filter("n > 1")
    return copies.select(
        "city_key", F.col("form").alias("form_a"), F.col("form").alias("form_b"),
        F.col("n").alias("n_a"), F.col("n").alias("n_b"),
        F.col("first_ord").alias("first_a"), F.col("first_ord").alias("first_b"))


_OUT = ("city_key", "form_a", "form_b", "n_a", "n_b", "first_a", "first_b", "similarity")


def similar_names(records: DataFrame, threshold: float = 0.6, name: str = "input_name", city: str | None = "city",
                  ord: str = "task_ord") -> DataFrame:
    """Pairs of token sets of one city: 0.95 when one contains the other, else their Jaccard index.

    A pair of rows with one form in common appears as that form with itself. `city=None` compares all rows;
    `city_key` is then empty.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    t = threshold
    forms = _counted(name_forms(records, token_form(F.col(name)), city, ord).filter("form <> ''"))
    words = forms.select("*", F.explode(F.split("form", " ")).alias("part"))
    frequency = words.groupBy("city_key", "part").agg(F.count("*").alias("df"))
    ranked = lookup_join(words, frequency, ["city_key", "part"], weight="df")
    # words of a form, rarest first: one order for all forms of a city
    ordered = (
        ranked.groupBy("city_key", "form", "n", "first_ord")
        .agg(F.array_sort(F.collect_list(F.struct("df", "part"))).alias("words"))
        .withColumn("toks", F.col("words.part"))
        .withColumn("size", F.size("words"))
    )
    cols = ("form", "n", "first_ord", "toks", "size")

    def parts(count: Column, only: Column | None = None) -> DataFrame:
        base = ordered if only is None else ordered.filter(only)
        return base.select("city_key", *cols, F.posexplode(F.slice("words", F.lit(1), count)).alias("at", "_word")).select(
            "*", "_word.df", "_word.part").drop("_word")

    # sets of a length and those up to 1/t times as long are in one interval or two that follow each other
    step = math.log(max(1 / t, 1.25))

    def interval(size: Column) -> Column:
        return F.floor(F.log(size.cast("double")) / step).cast("int")

    everything = parts(F.col("size"))
    shared = F.size(F.array_intersect("toks_a", "toks_b"))
    # A contained set shares its rarest word with the set around it.
    contained = (
        _pairs(parts(F.lit(1)), everything, *cols)
        .filter((F.col("size_a") < F.col("size_b")) & (shared == F.col("size_a")))
        .withColumn("similarity", F.lit(CONTAINED))
    )
    # A partial overlap of Jaccard >= t shares a word within these prefixes; sets too small for one are left out.
    can_overlap = (F.col("size") - 1) >= F.col("size") * t + t - _SLACK
    short_side = F.col("size") - F.ceil(F.col("size") * (2 * t / (1 + t)) - _SLACK) + 1
    long_side = F.col("size") - F.ceil(F.col("size") * t - _SLACK) + 1
    ahead = F.struct("size_a", "form_a") < F.struct("size_b", "form_b")
    short_parts = parts(short_side.cast("int"), can_overlap).withColumn("interval", F.explode(F.sequence(
        interval(F.col("size")), interval(F.floor(F.col("size") / t + _SLACK)))))
    long_parts = parts(long_side.cast("int")).withColumn("interval", interval(F.col("size")))
    # what both sets have from their first common word on
    at_most = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    overlap = (
        _pairs(short_parts, long_parts, *cols, "at", also=("interval",))
        .filter(ahead & (F.col("size_a") >= F.col("size_b") * t - _SLACK))
        .filter(at_most >= (F.col("size_a") + F.col("size_b")) * (t / (1 + t)) - _SLACK)
        # report a pair only at its first common word
        .filter(F.get(F.array_intersect("toks_a", "toks_b"), F.lit(0)) == F.col("part"))
        .withColumn("shared", shared).filter(F.col("shared") < F.col("size_a"))
        .withColumn("similarity", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")))
    )
    found = contained.unionByName(overlap, allowMissingColumns=True).withColumnsRenamed(
        {"first_ord_a": "first_a", "first_ord_b": "first_b"})
    same = _same_form(forms).withColumn("similarity", F.lit(CONTAINED))
    return found.select(*_OUT).unionByName(same.select(*_OUT)).filter(F.col("similarity") >= t)


def fuzzy_name_pairs(records: DataFrame, threshold: float = 0.82, name: str = "input_name", city: str | None = "city",
                     ord: str = "task_ord") -> DataFrame:
    """Pairs of compact names of one city: equal, one inside the other, or close by edit distance.

    `similarity` is 1 for equal and contained names, else 1 - distance / longer length. `city=None` compares all
    rows; `city_key` is then empty. The rows made of a name grow with its length, not with a power of it.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be above 0.5 and at most 1")
    forms = spread(settle(_counted(name_forms(records, names.plain_form(F.col(name)), city, ord)).withColumn(
        "size", F.length("form")), "name-forms"), each=PARTS_OF_NAME)
    cols = ("form", "n", "first_ord", "size")
    filled = forms.filter("size > 0")

    # contained: the rarest gram of the shorter name occurs in the longer one
    gram_sizes = (1, 2, 3, 5)
    own = F.greatest(*[F.when(F.col("size") >= q, F.lit(q)) for q in gram_sizes])

    def grams(q: Column) -> Column:
        at = F.when(F.col("size") >= q, F.sequence(F.lit(1), F.col("size") - q + 1))
        return F.array_distinct(F.transform(at, lambda i: F.substr("form", i, q)))

    all_grams = F.array_distinct(F.flatten(F.array_compact(F.array(*[grams(F.lit(q)) for q in gram_sizes]))))
    held = filled.select("city_key", *cols, F.explode(all_grams).alias("part"))
    frequency = held.groupBy("city_key", "part").agg(F.count("*").alias("df"))
    counted = lookup_join(held, frequency, ["city_key", "part"], weight="df")
    rarest = (
        counted.withColumn("own", own).filter(F.length("part") == F.col("own"))
        .groupBy("city_key", *cols).agg(F.min(F.struct("df", "part")).alias("best"))
        .select("city_key", *cols, "best.df", "best.part")
    )
    contained = (
        _pairs(rarest, counted, *cols)
        .filter((F.col("size_a") < F.col("size_b")) & F.contains("form_b", "form_a"))
        .withColumn("similarity", F.lit(1.0))
    )

    # close: k edits leave one of k+1 segments of the shorter name whole, at nearly the same place
    def edits(size: Column) -> Column:
        return F.floor(size * (1 - threshold) + _SLACK).cast("int")

    short = max(SHORT_NAME, math.ceil(4 / (2 * threshold - 1)))
    longest = F.floor(F.col("size") / threshold + 1).cast("int")
    allowances = F.array_distinct(F.transform(F.sequence(F.col("size"), longest), edits))
    allowances = F.filter(allowances, lambda k: k > 0)
    segments = (
        filled.filter(F.col("size") <= short).select("city_key", *cols, F.explode(allowances).alias("k"))
        .select("*", F.posexplode(F.sequence(F.lit(0), F.col("k"))).alias("i", "_seg"))
        .withColumn("start", _segment_start(F.col("size"), F.col("k"), F.col("i")))
        .withColumn("stop", _segment_start(F.col("size"), F.col("k"), F.col("i") + 1))
        .withColumn("part", F.concat_ws(
            "|", "size", "k", "i", F.substr("form", F.col("start") + 1, F.col("stop") - F.col("start"))))
    )
    probes = (
        filled.withColumn("k", edits(F.col("size"))).filter((F.col("k") > 0) & (F.col("size") - F.col("k") <= short))
        .select("city_key", *cols, "k", F.explode(F.sequence(F.col("size") - F.col("k"), F.least("size", F.lit(short)))).alias("len"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
        .withColumn("start", _segment_start(F.col("len"), F.col("k"), F.col("i")))
        .withColumn("stop", _segment_start(F.col("len"), F.col("k"), F.col("i") + 1))
        .withColumn("gap", F.col("size") - F.col("len"))
        .withColumn("shift", F.explode(F.sequence(
            -F.floor((F.col("k") - F.col("gap")) / 2), F.floor((F.col("k") + F.col("gap")) / 2))))
        .withColumn("at", F.col("start") + F.col("shift"))
        .filter((F.col("at") >= 0) & (F.col("at") + F.col("stop") - F.col("start") <= F.col("size")))
        .withColumn("part", F.concat_ws(
            "|", "len", "k", "i",
            F.substr("form", (F.col("at") + 1).cast("int"), F.col("stop") - F.col("start"))))
    )
    held_by = ("city_key", *cols, "part")
    long_segments, long_probes = _grams_in_cells(filled.filter(F.col("size") > short), cols, edits, threshold)
    segments = settle(segments.select(*held_by).unionByName(long_segments.select(*held_by)), "name-parts")
    # a name may have one part at several places
    probes = settle(probes.select(*held_by).distinct().unionByName(long_probes.select(*held_by)), "name-parts")
    weights = probes.groupBy("city_key", "part").agg(F.count("*").alias("df")).join(
        segments.groupBy("city_key", "part").agg(F.count("*").alias("held")), ["city_key", "part"])
    met = [settle(lookup_join(rows, weights, ["city_key", "part"], weight="df").filter(F.col("df").isNotNull()), "weighed-parts") for rows in (segments, probes)]
    heavy = ~F.col("part").startswith("L") & (F.col("df") * F.col("held") >= HEAVY_PAIRS) & F.lit(short <= closeness.LONGEST)
    light = (
        _pairs(*[rows.filter(~heavy) for rows in met], *cols)
        .filter(F.struct("size_a", "form_a") < F.struct("size_b", "form_b"))
        .filter(~F.contains("form_b", "form_a"))
        .withColumn("most", edits(F.col("size_b"))).filter(F.col("size_b") - F.col("size_a") <= F.col("most"))
        .withColumn("d", F.expr("levenshtein(form_a, form_b, most)")).filter("d >= 0")
    )
    paired = ["city_key", *[f"{c}_{s}" for s in "ab" for c in cols], "d"]
    # names with segments report a pair at its first common one; close pairs of longer names are shuffled, not all that met
    parted = light.filter(F.col("size_a") <= short).filter(~_met_before()).select(*paired).unionByName(
        light.filter(F.col("size_a") > short).select(*paired).distinct())
    if not met[0].filter(heavy).isEmpty():
        parted = parted.unionByName(_heavy_pairs(*[rows.filter(heavy) for rows in met], cols, threshold).select(*paired))
    close = parted.withColumn("similarity", 1 - F.col("d") / F.col("size_b")).filter(F.col("similarity") >= threshold - _SLACK)
    found = contained.unionByName(close, allowMissingColumns=True).withColumnsRenamed(
        {"first_ord_a": "first_a", "first_ord_b": "first_b"})
    same = _same_form(forms).withColumn("similarity", F.lit(1.0))
    return found.select(*_OUT).unionByName(same.select(*_OUT))


def _met_before() -> Column:
    """Whether a pair with a common segment also shares one of the segments before it."""
    k, i = (F.split("part", r"\|")[at].cast("int") for at in (1, 2))
    gap = F.col("size_b") - F.col("size_a")

    def shared(j: Column) -> Column:
        start = _segment_start(F.col("size_a"), k, j)
        length = _segment_start(F.col("size_a"), k, j + 1) - start

        def at_shift(shift: Column) -> Column:
            at = start + shift
            return (at >= 0) & (at + length <= F.col("size_b")) & (
                F.substr("form_b", (at + 1).cast("int"), length) == F.substr("form_a", start + 1, length))

        return F.exists(F.sequence(-F.floor((k - gap) / 2), F.floor((k + gap) / 2)), at_shift)

    return F.exists(F.sequence(F.lit(0), k), lambda j: (j < i) & shared(j))


def _heavy_pairs(segments: DataFrame, probes: DataFrame, cols: tuple[str, ...], threshold: float) -> DataFrame:
    """(city_key, form_a, form_b, ..., d): close pairs with a common segment, each at its first one; distances are worked out for many pairs at once.

    The shorter names of a part are spread over salts, ROWS_HELD in one task at once; the longer ones come in streams.
    """
    salts = F.ceil(F.col("held") / F.lit(ROWS_HELD)).cast("bigint")
    on = ["city_key", "part", "salt"]
    rows = segments.withColumn("salt", F.pmod(F.xxhash64("form"), salts)).select(*on, F.lit(False).alias("asks"), *cols).unionByName(
        probes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).select(*on, F.lit(True).alias("asks"), *cols))
    tasks = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    out = segments.select("city_key", *[F.col(c).alias(f"{c}_{side}") for side in "ab" for c in cols]).schema.add("d", "integer")
    at_once = _ROWS_ASKED

    def compare(key: tuple, a: pa.RecordBatch, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        k, i = map(int, key[1].split("|")[1:3])
        forms_a, forms_b = a.column("form").to_pylist(), b.column("form").to_pylist()
        size, sizes = len(forms_a[0]), np.array([len(x) for x in forms_b])
        allowed = np.floor(sizes * (1 - threshold) + _SLACK).astype(np.int64)
        letters = [closeness.codes(x) for x in (forms_a, forms_b)]
        after = np.array([bisect.bisect_right(forms_b, x) for x in forms_a])  # places of greater names
        for one, two, d in closeness.close_pairs(forms_a, forms_b, allowed):
            sizes_b = sizes[two]
            good = (sizes_b - size <= allowed[two]) & ((sizes_b > size) | ((sizes_b == size) & (two >= after[one])))
            one, two, d = one[good], two[good], d[good]
            good = ~closeness.met_before(letters[0][one], letters[1][two], size, sizes[two], k, i)
            good[good] = [forms_a[x] not in forms_b[y] for x, y in zip(one[good].tolist(), two[good].tolist())]
            if good.any():
                one, two, d = one[good], two[good], d[good]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * len(one), pa.string()), *[side.column(c).take(pa.array(at)) for side, at in ((a, one), (b, two)) for c in cols], pa.array(d.astype(np.int32))],
                    out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, asking = None, [], []

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal held, asking
            if held and asking:
                held = [pa.concat_batches(held)]
                yield from compare(name, held[0], pa.concat_batches(asking))
            asking = []

        for batch in batches:
            keys = [batch.column(c) for c in (*on, "asks")]
            starts = [0, *(np.flatnonzero(np.any([_changes(x) for x in keys], axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(starts, starts[1:]):
                if low == high:
                    continue
                *key, asks = (x[low].as_py() for x in keys)
                if tuple(key) != name:
                    yield from answer()
                    name, held = tuple(key), []
                for at in range(low, high, at_once):
                    (asking if asks else held).append(batch.slice(at, min(at_once, high - at)))
                    if sum(x.num_rows for x in asking) >= at_once:
                        yield from answer()
        yield from answer()

    return rows.repartition(tasks, *on).sortWithinPartitions(*on, "asks", "form").mapInArrow(run, out)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it."""
    return pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)


def _grams_in_cells(filled: DataFrame, cols: tuple[str, ...], edits, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Parts of the shorter and of the longer name of a pair, for names of any length.

    Longer names are sorted by intervals of length, and each interval has one number of edits k and one gram length q. A shorter
    name is cut into k+1 segments of at least q characters: one of them is whole in the longer name, at most k places
    away. So the longer name gives all its grams with the cell of k+1 places they stand in, and the shorter one the
    beginning of each segment with the two or three cells it may stand in.
    """
    bits = max(4, math.ceil(math.log2((1 - threshold) / (0.75 * (2 * threshold - 1)))) if threshold < 1 else 4)

    def width(size: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), F.length(F.bin(size)) - 1 - bits)).cast("int"))

    def interval(size: Column) -> Column:
        return size - F.pmod(size, width(size))

    low = F.col("low")

    def measured(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("high", low + width(low) - 1).withColumn("k", edits(F.col("high"))).filter("k > 0")
            .withColumn("least", low - edits(low)).withColumn("q", F.floor(F.col("least") / (F.col("k") + 1)).cast("int")))

    def part(cell: Column, gram: Column) -> Column:
        return F.concat_ws("|", F.lit("L"), low, cell, gram)

    def cell(place: Column) -> Column:
        return F.floor(place / (F.col("k") + 1)).cast("int")

    longest = F.floor(F.col("size") / threshold + 1).cast("int")
    shorter = measured(filled.select("city_key", *cols, F.explode(F.array_distinct(
        F.transform(F.sequence(F.col("size"), longest), interval))).alias("low"))).filter("size >= least AND size <= high")
    back = F.floor((F.col("k") - F.greatest(F.lit(0), low - F.col("size"))) / 2)
    ahead = F.floor((F.col("k") + F.col("high") - F.col("size")) / 2)

    def places(i: Column) -> Column:
        start = _segment_start(F.col("size"), F.col("k"), i)
        cells = F.sequence(cell(F.greatest(F.lit(0), start - back)), cell(start + ahead))
        return F.transform(cells, lambda c: part(c, F.substr("form", start + 1, F.col("q"))))

    segments = shorter.withColumn("part", F.explode(F.array_distinct(F.flatten(
        F.transform(F.sequence(F.lit(0), F.col("k")), places)))))
    longer = measured(filled.withColumn("low", interval(F.col("size"))))
    probes = longer.withColumn("part", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.col("size") - F.col("q")), lambda at: part(cell(at), F.substr("form", at + 1, F.col("q")))))))
    return segments, probes


def _segment_start(size: Column, k: Column, i: Column) -> Column:
    """Start of segment i when a name of this size is cut into k+1 nearly equal segments."""
    return F.floor(size * i / (k + 1)).cast("int")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
