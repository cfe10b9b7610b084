"""Mixing sources to target weights, by packed blocks.

The words of each source, its documents in pseudorandom order, form one stream that is
cut into blocks of fixed length. An output is a row of slots, dealt to shards. Each slot
has a source and a number among that source's slots; the number goes through the source's
pseudorandom permutation of block indices, one permutation for each pass over the source;
blocks and slots are joined by index.

The source counts of a shard are drawn from the multinomial, given the counts of the whole
mix: all slots of the output are permuted, and a shard is a stretch of that order. Free
draws would miss a target by the square root of its slots; these meet it to a block.

Permutations are swap-or-not shuffles: arithmetic on one index, exact on any range, no
sort. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import materialize, n_words, quoted, small, WORD

BLOCK_WORDS = 128
SHARD_SLOTS = 4096
#: No source, and so no document, is taken more often than this.
MOST_TIMES = 3
PERMUTATION_ROUNDS = 16
#: Documents of a source are numbered in so many runs, each by a task of its own.
RUNS = 1024
#: Slots that one row grows to at most, slots of a task (about), and tasks at most.
SLOT_CHUNK, TASK_SLOTS, SLOT_TASKS = 8192, 32_768, 20_000
#: Sources numbered by one task, about.
SOURCE_CHUNK = 65_536


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1, another one for each key."""

    def turn(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("pair"), i, *key), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, partner), i, *key) % 2 == 0, x).otherwise(partner)

    return F.aggregate(F.array(*map(F.lit, range(PERMUTATION_ROUNDS))), index.cast("long"), turn)


def numbered(sizes: DataFrame) -> DataFrame:
    """Adds sid, the place of each source by code point, null last. Sources are dealt to ranges, so no task orders more than about SOURCE_CHUNK of them."""
    order = F.col("source").asc_nulls_last()
    ranges = 1 + sizes.count() // SOURCE_CHUNK
    place = F.monotonically_increasing_id()
    dealt = materialize(sizes.repartitionByRange(ranges, order).sortWithinPartitions(order).select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "mix-places")
    return running(dealt.groupBy("part").agg(F.count("*").alias("n")), "n", "part", "begin").select("part", "begin").join(dealt, "part").withColumn("sid", F.col("begin") + F.col("place")).drop("part", "begin", "place")


def running(rows: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """Adds the sum of value over all rows with a smaller key (numbered from 0). Only one sum for each SOURCE_CHUNK rows meets in one task."""
    rows = rows.withColumn("chunk", F.floor(F.col(key) / SOURCE_CHUNK))
    chunks = rows.groupBy("chunk").agg(F.sum(value).alias("in_chunk"))
    begin = F.coalesce(F.sum("in_chunk").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(chunks.select("chunk", begin.alias("chunk_begin")), "chunk").withColumn(name, F.col("chunk_begin") + within).drop("chunk", "chunk_begin")


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes: source, source_size. Adds sid, weight, target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. They share the sum of all sizes;
    what goes beyond MOST_TIMES a source's size is shared anew by weight, until no source is above it:
    one sum over the sources each time.
    """
    most, weight = F.col("source_size") * MOST_TIMES, F.col("sid") % 3 + 1
    sources = materialize(numbered(sizes).withColumn("weight", weight).withColumn("most", most).withColumn("room", most / weight), "mix-weights")
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = 0.0, (0, 0)
    while total and full[1] < weights:
        level = (total - full[0]) / (weights - full[1])
        filled = F.col("room") <= level
        now = sources.agg(F.coalesce(F.sum(F.when(filled, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(filled, F.col("weight"))), F.lit(0))).first()
        if now[1] == full[1]:
            break
        full = tuple(now)
    return sources.select("source", "source_size", "sid", "weight", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


class Mix:
    """A mix of docs. input: with rid, the number of each row; rows: with sid, source_size and target of its source; streamed: those with words, with their place (start) in the source's stream; sources; slots(); spans()."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 10, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> None:
        """Sizes are words; a null text has none and is never taken. A null source is a source. Repeated rows are rows of their own; rows without an id are put in order by their texts. keep: columns of docs to have in input, beside rid."""
        self.block_words, self.seed = block_words, seed
        base = docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            n_words(F.col(text_col)).alias("size"),
            F.monotonically_increasing_id().alias("rid"),
            F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col), F.lit(seed))).otherwise(F.xxhash64(F.col(id_col).cast("long"), F.lit(seed))).alias("order"),
            *(F.col(quoted(c)).alias(f"kept_{c}") for c in keep),
        )
        self.input = base = materialize(base, "mix-sizes")
        base = base.select("doc_id", "source", "size", "rid", "order")
        blocks = F.ceil(F.col("source_size") / block_words).cast("long")
        slots = F.when(blocks > 0, F.least(MOST_TIMES * blocks, F.round(F.col("target") * blocks / F.col("source_size")).cast("long"))).otherwise(0)
        sources = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("n_blocks", blocks).withColumn("n_slots", slots)
        self.sources = materialize(running(sources, "n_slots", "sid", "first_slot"), "mix-sources")
        self.all_slots = self.sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]

        named = small(self.sources.select(F.col("source").alias("its_source"), "sid", "source_size", "target"))
        self.rows = base.join(named, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
        streamed = self.rows.where("size > 0").withColumn("run", F.pmod("order", F.lit(RUNS)))
        before = streamed.groupBy("sid", "run").agg(F.sum("size").alias("run_size"))
        before = materialize(before.withColumn("run_start", F.sum("run_size").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("run_size")).drop("run_size"), "mix-runs")
        in_run = Window.partitionBy("sid", "run").orderBy("order", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
        self.streamed = streamed.join(small(before), ["sid", "run"]).withColumn("start", F.col("run_start") + F.sum("size").over(in_run) - F.col("size"))

    def slots(self) -> DataFrame:
        """shard, slot, sid, number (among the source's slots), times (passes before), block."""
        last = F.col("n_slots") - 1
        chunks = self.sources.where("n_slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / SLOT_CHUNK))))
        number = F.explode(F.sequence(F.col("chunk") * SLOT_CHUNK, F.least(last, (F.col("chunk") + 1) * SLOT_CHUNK - 1)))
        tasks = min(SLOT_TASKS, 1 + self.all_slots // TASK_SLOTS)  # named, or Spark would make one of them: the rows are few until they explode
        slots = chunks.repartition(tasks).withColumn("number", number).withColumn("times", F.floor(F.col("number") / F.col("n_blocks")))
        place = permuted(F.col("first_slot") + F.col("number"), F.lit(self.all_slots), F.lit(self.seed))
        block = permuted(F.col("number") % F.col("n_blocks"), F.col("n_blocks"), F.lit(self.seed), F.col("sid"), F.col("times"))
        slots = slots.withColumn("place", place)
        return slots.select(F.floor(F.col("place") / SHARD_SLOTS).alias("shard"), (F.col("place") % SHARD_SLOTS).alias("slot"), "sid", "number", "times", block.alias("block"))

    def spans(self) -> DataFrame:
        """What each slot takes: shard, slot, rid, times, first (word of the document), n (words)."""
        width, end = F.lit(self.block_words), F.col("start") + F.col("size")
        pieces = (
            self.streamed.select("sid", "rid", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((end - 1) / width))).alias("block"))
            .withColumn("first", F.greatest(F.lit(0).cast("long"), F.col("block") * width - F.col("start")))
            .withColumn("n", F.least(F.col("size"), (F.col("block") + 1) * width - F.col("start")) - F.col("first"))
            .select("sid", "block", "rid", "first", "n")
        )
        # both sides grow with the input, though Spark, which can't tell how far they explode, may take them for small
        return self.slots().join(pieces.hint("merge"), ["sid", "block"]).select("shard", "slot", "rid", "times", "first", "n")


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words that the mix takes of it, repeats counted)."""
    mix = Mix(docs, **options)
    taken = mix.spans().groupBy("rid").agg(F.sum("n").alias("taken"))
    return mix.rows.join(taken.hint("merge"), "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, in the columns of docs: a row for each pass over the source that takes words of a document.

    A pass that takes all words leaves the text as it is; else the text is the words taken, joined by one
    space, and n_chars (if there is one) their length. Texts without words are never taken.
    """
    columns = docs.columns
    mix = Mix(docs, keep=tuple(columns), **options)
    passes = mix.spans().groupBy("rid", "times").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("first", "n"))).alias("parts"))
    words = F.regexp_extract_all(F.col("kept_text"), F.lit(f"({WORD})"))
    # as an array of one, so that the words are taken out once and not for each part
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["n"].cast("int")))), " "))[0]
    text = F.when(F.col("n") == F.col("size"), F.col("kept_text")).otherwise(cut)
    out = mix.input.join(passes.hint("merge"), "rid").withColumn("kept_text", text)
    if "n_chars" in columns:
        out = out.withColumn("kept_n_chars", F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(quoted(f"kept_{c}")).alias(c) for c in columns))
