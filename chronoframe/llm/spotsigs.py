"""Document fingerprints: SpotSigs, in DataFrame functions only.

Common words are anchors. The chain of up to three content words that follows an anchor (or the start of the
text) is a spot; in a text without any anchor every chain of three words is one. The set of a text's distinct spots,
hashed, is its fingerprint. Two fingerprints compare by
Jaccard. In a join, texts are partitioned by set length (texts whose lengths differ by more than the threshold
allows never meet) and candidates come from the rarest spots of each, then the exact Jaccard decides.

Defined results: null text is empty; a text without any content word has one spot made of the whole text, so every text
has a fingerprint and equal texts have equal ones; rows are ordered by (doc_id, text) where ids repeat, null
ids first; the next document of the last is the first, that of a single one is itself; extra columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Anchors: the commonest function words of four languages.
ANCHORS = (
    "the a an is was are were be been to of in on and or that this it for with as by from at he she not "
    "der die das ein eine und ist zu den von mit sich des auf für nicht im dem er es "
    "le la les de un une et est en que qui dans du pour pas par sur au ne "
    "el los las del y por una con para se no su lo al o"
).split()
CHAIN = 3
#: Rows of one bucket of the ordering, about; cells of ids that the driver sets marks for, at most; marks looked through at once.
BUCKET, CELLS, RUN = 1024, 512, 32


def _alternatives(words: list[str]) -> str:
    """A pattern of the words that shares their beginnings, so that a word is looked up letter by letter."""
    after: dict[str, list[str]] = {}
    for w in words:
        after.setdefault(w[:1], []).append(w[1:])
    ends = "" in after
    rest = "|".join(c + (_alternatives(after[c]) if after[c] != [""] else "") for c in sorted(after) if c)
    return f"(?:{rest})" + ("?" if ends else "") if rest else ""


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def spots(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct hashes of the spots of a text."""
    words = F.concat(F.lit("  "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "  "), F.lit("  "))
    some = lambda chains: F.filter(chains, lambda p: p != "")
    after = lambda parts: F.transform(parts, lambda p: F.substring_index(F.trim(p), "  ", chain))
    every = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (chain - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, chain), "  "))
    chains = _let(F.split(words, f" {_alternatives(list(dict.fromkeys(anchors)))} "), lambda parts: some(F.when(F.size(parts) > 1, after(parts)).otherwise(_let(F.split(F.trim(parts[0]), "  "), every))))
    chains = _let(chains, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(text)))
    return F.sort_array(F.array_distinct(F.transform(chains, lambda c: F.substring(F.md5(c.cast("binary")), 1, 10))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two fingerprints."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _buckets(docs: DataFrame) -> tuple[Column, Column]:
    """Two numbers for each id, in the order of ids, whatever they are: a cell between marks that part the rows evenly, and a
    piece of the cell. The marks are approximate quantiles, CELLS at most; a cell of many rows has more pieces."""
    known = docs.where("doc_id is not null")
    n, low, high = known.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    cells = max(1, min(CELLS, -(-n // BUCKET)))
    shares = [k / cells for k in range(1, cells)]
    found = known.agg(F.percentile_approx("doc_id", shares, 20 * CELLS)).first()[0] if shares else []
    marks, pieces = sorted({*(found or [])}), -(-n // (cells * BUCKET))
    doc_id = F.col("doc_id")
    if marks:
        runs = [marks[k : k + RUN] for k in range(0, len(marks), RUN)]
        below = lambda values: F.size(F.filter(values, lambda m: m <= doc_id))
        lists = F.array(*(F.array(*map(F.lit, r)) for r in runs))
        tops = F.array(*(F.lit(r[0]) for r in runs[1:])) if len(runs) > 1 else F.array().cast("array<bigint>")
        cell = _let(below(tops), lambda j: j * RUN + below(F.element_at(lists, j + 1)))
    else:
        cell = F.lit(0)
    if pieces <= 1:
        return cell, F.lit(0).cast("long")
    edges = [float(x) for x in (low, *marks, high)]
    start, wide = (F.array(*map(F.lit, x)) for x in (edges[:-1], [max(b - a, 1.0) / pieces for a, b in zip(edges, edges[1:])]))
    return cell, _let(cell, lambda c: F.floor((doc_id.cast("double") - F.element_at(start, c + 1)) / F.element_at(wide, c + 1)))


def with_next(docs: DataFrame, made: dict[str, Column]) -> DataFrame:
    """doc_id, text, the columns made of text, and next_ of each: those of the next document by doc_id, the first after the
    last. Ids, sparse or dense, are dealt into buckets of neighbours; only the last row of a bucket looks for the first row of
    the next non-empty one, and for these few rows the columns are made anew."""
    columns, at = ["text", *made], ["cell", "piece"]
    # rows without an id come first, in order of their texts: their pieces are those of the first two characters
    first = lambda k: F.ascii(F.substring("text", k, 1)).cast("long")
    cell, piece = _buckets(docs)
    none = F.col("doc_id").isNull()
    base = docs.select("doc_id", "text", F.when(none, -1).otherwise(cell).alias("cell"), F.when(none, F.shiftleft(first(1), 21) + first(2)).otherwise(piece).alias("piece"))
    order = Window.partitionBy(*at).orderBy("doc_id", "text")
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    rows = base.withColumns(made).select("doc_id", *columns, *following).where("next_text is not null")
    edges = base.groupBy(*at).agg(F.min(F.struct("doc_id", "text")).alias("head"), F.max(F.struct("doc_id", "text")).alias("last"))
    last = edges.select(*at, "last.*").withColumns(made)
    heads = edges.select(F.struct(*at).alias("next"), "head.text").withColumns(made).select("next", *(F.col(c).alias(f"next_{c}") for c in columns))
    ends = last.join(_next_bucket(edges.select(*at)), at).join(heads, "next")
    return rows.union(ends.select(rows.columns))


def _next_bucket(buckets: DataFrame) -> DataFrame:
    """cell, piece, next: the bucket after each non-empty one, the first after the last. Pieces are ordered by cell; the cells,
    CELLS + 1 at most, as one."""
    here = F.struct("cell", "piece")
    inner = buckets.withColumn("next", F.lead(here).over(Window.partitionBy("cell").orderBy("piece")))
    tops = buckets.groupBy("cell").agg(F.min(here).alias("low"))
    everything = Window.orderBy("cell")
    tops = tops.select("cell", F.coalesce(F.lead("low").over(everything), F.first("low").over(everything)).alias("top"))
    return inner.join(tops, "cell").select("cell", "piece", F.coalesce("next", "top").alias("next"))


def fingerprint(spot_hashes: Column) -> Column:
    return F.array_join(spot_hashes, ",")


def spot_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """a, b, likeness: pairs of fingerprint representatives (the smallest doc_id of equal fingerprints) of at least
    threshold. Sets meet only inside a band of lengths, on one of the 1 + floor((1 - threshold) * length) rarest spots."""
    prints = docs.select("doc_id", spots(F.coalesce("text", F.lit(""))).alias("s")).groupBy("s").agg(F.min("doc_id").alias("doc_id"))
    prints = prints.withColumn("n", F.size("s"))
    band = F.floor(F.log("n") / F.log(F.lit(1 / threshold)) + 1e-9)
    each = prints.select("doc_id", "n", F.explode("s").alias("spot"))
    counts = each.groupBy("spot").agg(F.count("*").alias("df"))
    ranked = each.join(counts, "spot").where("df > 1").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "spot")))
    prefix = ranked.where(F.col("rank") <= 1 + F.floor((1 - threshold) * F.col("n") + 1e-9)).withColumn("band", band)
    left = prefix.select("spot", F.explode(F.array("band", F.col("band") + 1)).alias("meet"), F.col("doc_id").alias("a"), F.col("n").alias("na"))
    right = prefix.select("spot", F.col("band").alias("meet"), F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    close = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    once = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, ["spot", "meet"]).where(close & once).select("a", "b").distinct()
    sets = prints.select("doc_id", "s")
    pairs = pairs.join(sets.withColumnsRenamed({"doc_id": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "s": "sb"}), "b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = with_next(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), {"own": spots(F.col("text"))})
    n = F.char_length("text")
    m = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - m), F.substring(F.col("next_text"), F.lit(1), m))
    rows = rows.select("doc_id", "own", "next_own", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("doc_id", "own", "next_own", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), spots(F.col("edited")).alias("other"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def _sql_spots(text: str) -> str:
    anchors = "|".join(dict.fromkeys(ANCHORS))
    parts = rf"string_split_regex('  ' || regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', '  ', 'g') || '  ', ' (?:{anchors}) ')"
    words = f"string_split(trim({parts}[1]), '  ')"
    every = f"list_transform(generate_series(1, greatest(len({words}) - {CHAIN - 1}, 1)), lambda i: array_to_string({words}[i:i + {CHAIN - 1}], '  '))"
    after = f"list_transform({parts}, lambda p: array_to_string(string_split(trim(p), '  ')[1:{CHAIN}], '  '))"
    chains = f"list_filter(CASE WHEN len({parts}) > 1 THEN {after} ELSE {every} END, lambda p: p <> '')"
    return f"list_sort(list_distinct(list_transform(CASE WHEN len({chains}) > 0 THEN {chains} ELSE [{text}] END, lambda c: md5(c)[1:10])))"


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text)::BIGINT AS n_chars,
             coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS next_text FROM d),
e AS (SELECT *, text[1:n_chars - n_chars // 4] || next_text[1:n_chars // 4] AS edited FROM n),
s AS (SELECT doc_id, n_chars, edited, {_sql_spots("text")} AS own, {_sql_spots("edited")} AS other, {_sql_spots("next_text")} AS nxt FROM e)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(own, ',') AS fingerprint, array_to_string(other, ',') AS edited_fingerprint,
       len(list_intersect(own, other)) / (len(own) + len(other) - len(list_intersect(own, other))) AS near_edited,
       len(list_intersect(own, nxt)) / (len(own) + len(nxt) - len(list_intersect(own, nxt))) AS near_next
FROM s
"""
