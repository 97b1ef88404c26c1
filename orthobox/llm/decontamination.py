"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Words are lower-cased (A-Z) runs of digits, letters and everything beyond ASCII. Each text keeps, of every SPAN - GRAM + 1
neighbouring grams of GRAM words, the leftmost of least hash, so any two texts that share SPAN words keep a common gram
there. Kept grams of documents that are kept grams of test items are the seeds. Each seed is extended to all windows of
SPAN words that hold it, and those are joined with the items' windows as text, so that a hit is never a collision. Items
shorter than SPAN are one window; documents are searched for windows of their lengths at every place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthobox.llm._rows import free_name
from orthobox.llm._shared import settled

SPAN = 10
GRAM = 5
#: Test fingerprints, windows and seeds are broadcast up to so many rows (some tens of MB), and shuffled beyond.
BROADCAST_ROWS = 300_000
#: Beyond that, rows are dealt by text and by one of so many shares, so that copies of one text do not meet in one task.
SHARES = 64

# The letters that are lower-cased, what a word is, and what is between words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of a kept gram that hold its place; the others hold its hash.
PLACE_BITS = 30


def words(text: Column) -> Column:
    """A text's words; null has none. Only A-Z are lower-cased, which for ASCII texts is lower().

    Cutting at what is no word takes half the time of extracting each word.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, GAP), "")


def _rolled(df: DataFrame, column: str, name: str, width: int, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """df with `name`: the array column's values combined over each `width` neighbours, by doubling: a pass over two arrays
    at a time takes a tenth of the time of looking values up by place. Spans may overlap when they are combined."""
    now, size = column, 1
    while size < width:
        step = min(size, width - size)
        df = df.withColumn(f"{name}_{size}", F.zip_with(now, F.slice(now, step + 1, F.size(now)), combine))
        now, size = f"{name}_{size}", size + step
    return df.withColumn(name, F.slice(now, 1, F.greatest(F.size(now) - (width - 1), F.lit(0))))


def _grams(df: DataFrame, size: int, name: str) -> DataFrame:
    """df (column hashes) with, for each `size` neighbouring hashes, a long: their hash in the high bits, their place below."""
    low = (1 << PLACE_BITS) - 1
    df = _rolled(df, "hashes", f"{name}_hash", size, lambda a, b: F.xxhash64(a, b))
    return df.withColumn(name, F.transform(f"{name}_hash", lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))


def _seeds(df: DataFrame, span: int, gram: int, long: bool, short: Sequence[int]) -> DataFrame:
    """df (column hashes) with `seeds`, structs of size and seed: of each span - gram + 1 neighbouring grams the least one, the
    leftmost of equals, as a window of `span` words; and all grams of the short sizes."""
    every = []
    if long:
        df = _rolled(_grams(df, gram, "grams"), "grams", "least", span - gram + 1, lambda a, b: F.least(a, b))
        every.append((span, F.array_distinct("least")))
    for s in short:
        df = _grams(df, s, f"grams_of_{s}")
        every.append((s, F.col(f"grams_of_{s}")))

    def sized(seeds: Column, size: int) -> Column:
        return F.transform(seeds, lambda x: F.struct(F.lit(size).alias("size"), x.alias("seed")))

    arrays = [sized(seeds, size) for size, seeds in every]
    return df.withColumn("seeds", F.concat(*arrays) if len(arrays) > 1 else arrays[0] if arrays else sized(F.slice("hashes", 1, 0), 0))


def _parts(seed: str) -> list[Column]:
    """A gram's hash and its place."""
    return [F.shiftright(seed, PLACE_BITS).alias("hash"), F.col(seed).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("place")]


def _hashes(words_of: Column) -> Column:
    return F.transform(words_of, lambda w: F.xxhash64(w))


def _small(df: DataFrame) -> DataFrame:
    """The same rows, to be broadcast if they are few; they are counted first."""
    df = settled(df)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _join_by_text(rows: DataFrame, found: DataFrame, size: int, how: str) -> DataFrame:
    """rows and found joined by sha, of which found has one row each, `size` rows and list items together."""
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), "sha", how)
    share = free_name("share", rows.columns)
    dealt = rows.withColumn(share, F.floor(F.rand(7) * SHARES).cast("int"))
    return dealt.join(found.withColumn(share, F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), ["sha", share], how).drop(share)


def _windows(words_of: Column, starts: Column) -> Column:
    """The window of words at each (start, size): structs of start, size and window."""
    return F.transform(starts, lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), F.array_join(F.slice(words_of, x["start"] + 1, x["size"]), " ").alias("window")))


def _starts(seeds: Column, n: Column, span: int, gram: int) -> Column:
    """The windows within n words that hold a seed; a seed of a short size is its own window."""

    def around(s: Column) -> Column:
        first = F.greatest(F.lit(0), s["place"] - (span - gram))
        last = F.least(s["place"], n - span)
        own = F.array(F.struct(s["place"].alias("start"), s["size"].alias("size")))
        # Not both conditions in one: sequence() would count downwards where last < first.
        many = F.when(last >= first, F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("start"), F.lit(span).alias("size")))).otherwise(F.slice(own, 1, 0))
        return F.when(s["size"] < span, own).otherwise(many)

    return F.array_distinct(F.flatten(F.transform(seeds, around)))


def _rows_with_seeds(documents: DataFrame, key: str | None, text: str, prints: DataFrame, span: int, gram: int, long: bool, short: Sequence[int]) -> DataFrame:
    """One row per document: key, sha (the text's SHA-256), n_words, and seeds (size, place), the grams that are prints.

    Texts are read, cut and hashed once. A document's seeds are its rows, the first of which names it; others go unless prints.
    """
    own = F.col(f"`{key}`") if key else F.lit(None).cast("string")
    docs = documents.select(own.alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("row"))
    hashed = docs.select("row", "key", F.sha2("t", 256).alias("sha"), _hashes(words(F.col("t"))).alias("hashes"))
    named = F.col("pos").isNull() | (F.col("pos") == 0)
    every = _seeds(hashed, span, gram, long, short).select("row", "key", "sha", F.size("hashes").cast("long").alias("n_words"), F.posexplode_outer("seeds").alias("pos", "s"))
    every = every.select("row", F.when(named, F.struct("key", "sha", "n_words")).alias("d"), F.coalesce("s.size", F.lit(0)).alias("size"), F.col("s.seed").alias("seed"))
    # Documents without grams get hashes of their own, so that they share no key.
    every = every.select("row", "d", "size", F.coalesce(_parts("seed")[0], "row").alias("hash"), _parts("seed")[1])
    met = every.join(_small(prints.withColumn("known", F.lit(True))), ["size", "hash"], "left").filter("known or d is not null")
    found = met.groupBy("row").agg(F.first("d", ignorenulls=True).alias("d"), F.collect_list(F.when(F.col("known"), F.struct("size", "place"))).alias("seeds"))
    return settled(found.select("d.key", "d.sha", "d.n_words", "seeds"))


def _hits(documents: DataFrame, key: str | None, text: str, items: DataFrame, item_key: str, item_text: str, span: int, gram: int) -> tuple[DataFrame, DataFrame, int]:
    """Per document key, sha and n_words; per different text with a hit sha, n_hit words and items (keys as sorted strings);
    and how many rows and items the latter has.

    Null item keys name no item, but their windows still hit.
    """
    if not 1 <= gram <= span:
        raise ValueError("gram: 1 to span words")
    tests = settled(items.select(F.col(f"`{item_key}`").cast("string").alias("item"), words(F.col(f"`{item_text}`")).alias("words")).filter(F.size("words") > 0))
    sizes = sorted(r["n"] for r in tests.select(F.least(F.size("words"), F.lit(span)).alias("n")).distinct().collect())  # span values at most
    long, short = span in sizes, [n for n in sizes if n < span]
    n = F.size("words")
    at = F.when(n >= span, F.transform(F.sequence(F.lit(0), F.greatest(n - span, F.lit(0))), lambda i: F.struct(i.alias("start"), F.lit(span).alias("size")))).otherwise(F.array(F.struct(F.lit(0).alias("start"), n.alias("size"))))
    # Items that hold the same windows are named by their set, so that a document's rows do not multiply with them.
    named = tests.select("item", F.explode(_windows(F.col("words"), at)).alias("w")).groupBy("w.window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = settled(named.withColumn("set", F.md5(F.to_json("items"))))
    sets = named.groupBy("set").agg(F.first("items").alias("items"))
    own = tests.select(n.alias("n"), _hashes(F.col("words")).alias("hashes"))
    prints = None
    for size in sizes:
        of_size = own.filter(F.col("n") >= span if size == span else F.col("n") == size)
        seeds = _seeds(of_size, span, gram, size == span, [] if size == span else [size]).select(F.explode("seeds").alias("s")).select("s.size", "s.seed").select("size", _parts("seed")[0])
        prints = seeds if prints is None else prints.unionByName(seeds)
    if prints is None:
        prints = own.select(F.col("n").alias("size"), F.lit(0).cast("long").alias("hash")).limit(0)

    rows = _rows_with_seeds(documents, key, text, prints.distinct(), span, gram, long, short)
    seeded = rows.filter(F.size("seeds") > 0).groupBy("sha").agg(F.first("seeds").alias("seeds"))
    total = seeded.agg(F.coalesce(F.sum(F.size("seeds") + 1), F.lit(0))).first()[0]
    texts = documents.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).withColumn("sha", F.sha2("t", 256))
    split = _join_by_text(texts, seeded, total, "inner").groupBy("sha").agg(F.first("t").alias("t"), F.first("seeds").alias("seeds")).select("sha", "seeds", words(F.col("t")).alias("words"))
    windows = split.select("sha", F.explode(_windows(F.col("words"), _starts(F.col("seeds"), F.size("words"), span, gram))).alias("w")).select("sha", "w.start", "w.size", "w.window")
    hit = windows.join(_small(named.select("window", "set")), "window").groupBy("sha").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"), F.collect_set("set").alias("sets"))

    def covered(acc: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["upto"], x["start"]))).alias("n"))

    hit = settled(hit.withColumn("n_hit", F.aggregate("spans", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n")), lambda a, x: covered(a, x).cast("struct<upto:int,n:bigint>"), lambda a: a["n"])).drop("spans"))
    of_items = hit.select("sha", F.explode("sets").alias("set")).join(sets, "set").select("sha", F.explode("items").alias("item")).groupBy("sha").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hit = settled(hit.select("sha", "n_hit").join(of_items, "sha", "left").select("sha", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")))
    return rows.select("key", "sha", "n_words"), hit, hit.agg(F.coalesce(F.sum(F.size("items") + 1), F.lit(0))).first()[0]


def clean_rows(documents: DataFrame, text: str, items: DataFrame, item_key: str, item_text: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The input's rows and columns, whatever their names, without the rows that a window of an item occurs in.

    Null, empty and wordless texts stay, and so do repeated rows; an empty table of either kind takes nothing away.
    """
    _, hit, _ = _hits(documents, None, text, items, item_key, item_text, span, gram)
    sha = free_name("sha", documents.columns)
    dealt = documents.select("*", F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256).alias(sha))
    names = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    plain = dealt.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()], F.col(sha).alias("sha"))
    left = _join_by_text(plain, hit.select("sha"), hit.count(), "left_anti")
    return left.select(*[F.col(x).alias(c) for c, x in names.items()])


def find_contamination(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per input row: key, n_words, n_hit, n_items, items_sha256 and contaminated.

    A window is `span` consecutive words of an item, or all of a shorter one. A document's word inside an occurrence of a
    window is hit. Null and wordless texts have no words and no hits; an empty item table hits nothing, and no documents give
    no rows; repeated rows get the same result each. Hits are found once for equal texts. Of grams with equal hashes the
    leftmost is kept. Other columns, whatever their names, are dropped.

    A long text is searched whole, as one array of its words.
    """
    rows, hit, size = _hits(documents, key, text, items, item_key, item_text, span, gram)
    n_hit, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return _join_by_text(rows, hit, size, "left").select(F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') w from documents),
i as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') w from benchmark),
tests as (select item, w, least(len(w), {SPAN}) size from i where len(w) > 0),
windows as (select distinct item, size, array_to_string(w[s : s + size - 1], ' ') x
  from (select item, w, size, unnest(range(1, len(w) - size + 2)) s from tests)),
places as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) s from d, (select distinct size from tests) where len(w) >= size),
hit as (select doc_id, s, p.size, item from (select doc_id, s, size, array_to_string(w[s : s + size - 1], ' ') x from places) p
  join windows using (x)),
covered as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(s, s + size)) p from (select distinct doc_id, s, size from hit)) group by 1),
named as (select doc_id, count(*) n, string_agg(item, ',' order by item) items from (select distinct doc_id, item from hit) group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(c.n, 0) as bigint) n_hit, cast(coalesce(m.n, 0) as bigint) n_items,
  sha256(coalesce(m.items, '')) items_sha256, coalesce(c.n, 0) > 0 contaminated
from d left join covered c using (doc_id) left join named m using (doc_id)
"""
