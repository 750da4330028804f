"""The same or nearly the same records across splits, by an edit-distance segment join.

Only records that cite the same sections can be cases, so the join runs within a key of both citations. The first text
of an evaluation record (in the order of its citations, which settles exchanged roles) is cut into k + 1 segments per
sentence, k being the edits a sentence of its length may have; a training text that is within them holds one of the
segments unchanged, at most k words from its place in the sentence or in the text. Such pairs are checked in both texts
by dynamic programming in a band of k. Copies are compared once and expanded at the end.

In scripts without spaces the units are letters, and the text as a whole is cut into k + 1 segments.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.citation import cited_base, is_blank
from citeloom.llm.neardup import fold
from citeloom.session import cut_lineage

#: One edit in so many words (letters) is allowed.
EDIT_EVERY = 4
_THAI = re.compile(r"[฀-๿]")
_SENTENCE_END = re.compile(r"(?<=[.!?;。])\s+|[\r\n]+")
SEP = "\u0001"


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text as lists of folded words; in scripts without spaces its chunks as lists of letters."""
    if not text or not fold(text):
        return []
    whole = fold(text)
    if " " not in whole and _THAI.search(whole):
        return [list(x) for x in (fold(c) .replace(" ", "") for c in text.split()) if x]
    return [x.split(" ") for x in (fold(s) for s in _SENTENCE_END.split(text)) if x]


def unspaced(text: str) -> bool:
    whole = fold(text)
    return " " not in whole and bool(_THAI.search(whole))


def segments(n: int) -> list[tuple[int, int]]:
    """(start, length) of the k + 1 segments of a sentence of n words, k = n // EDIT_EVERY; as even as can be."""
    pieces = n // EDIT_EVERY + 1
    short, longer = n // pieces, n % pieces
    out, at = [], 0
    for i in range(pieces):
        size = short + (i >= pieces - longer)
        out.append((at, size))
        at += size
    return out


def probe_rows(text: str) -> list[tuple[str, int, int, int]]:
    """(segment, place in the sentence, place in the text, edits allowed) of an evaluation text."""
    if unspaced(text):
        chunks = sentences(text)
        flat = "".join("".join(s) for s in chunks)
        # Chunks may have changed places, so a place in the text tells nothing where there are several.
        k = len(flat) // EDIT_EVERY if len(chunks) == 1 else len(flat)
        return [(flat[i : i + n], i, i, k) for i, n in segments(len(flat))]
    out, base = [], 0
    for words in sentences(text):
        k = len(words) // EDIT_EVERY
        out += [(" ".join(words[i : i + n]), i, base + i, k) for i, n in segments(len(words))]
        base += len(words)
    return out


def index_rows(text: str) -> list[tuple[str, int, int]]:
    """(substring, place in the sentence, place in the text) of a training text: those that a segment may equal."""
    if unspaced(text):
        flat = "".join("".join(s) for s in sentences(text))
        return sorted({(flat[i : i + n], i, i) for n in _sizes(len(flat)) for i in range(len(flat) - n + 1)})
    out, base = [], 0
    for words in sentences(text):
        out += [(" ".join(words[i : i + n]), i, base + i) for n in _sizes(len(words)) for i in range(len(words) - n + 1)]
        base += len(words)
    return out


def _sizes(n: int) -> list[int]:
    """The lengths of segments of a text from which one of n units may come by the edits allowed."""
    lengths = range(max(1, n - n // EDIT_EVERY - 1), n + n // (EDIT_EVERY - 1) + 2)
    return sorted({size for m in lengths for _, size in segments(m) if size <= n})


def banded(a: list[str], b: list[str], k: int) -> bool:
    """Whether at most k edits turn a into b: dynamic programming over the 2k + 1 diagonals around the main one."""
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    big = k + 1
    row = [j if j <= k else big for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - k), min(len(b), i + k)
        new = [big] * (len(b) + 1)
        if i <= k:
            new[0] = i
        for j in range(lo, hi + 1):
            d = row[j - 1] + (x != b[j - 1])
            if row[j] + 1 < d:
                d = row[j] + 1
            if new[j - 1] + 1 < d:
                d = new[j - 1] + 1
            new[j] = d if d < big else big
        if min(new[max(0, lo - 1) : hi + 1]) > k:
            return False
        row = new
    return row[-1] <= k


def _place(part: list[str], whole: list[str]) -> int:
    """Where in ``whole`` the run nearest to ``part`` ends, by edit distance; the first of equals."""
    row = [0] * (len(whole) + 1)
    for i, x in enumerate(part, 1):
        new = [i]
        for j, y in enumerate(whole, 1):
            d = row[j - 1] + (x != y)
            if row[j] + 1 < d:
                d = row[j] + 1
            if new[j - 1] + 1 < d:
                d = new[j - 1] + 1
            new.append(d)
        row = new
    return row.index(min(row))


def _aligned(parts: list[list[str]], whole: list[str]) -> list[str]:
    """The sentences ``parts`` in the order in which they stand in ``whole``, whose own sentence ends don't count."""
    order = sorted(range(len(parts)), key=lambda i: (_place(parts[i], whole), i))
    return [w for i in order for w in parts[i]]


def same_text(a: str, b: str) -> bool:
    """Whether two texts are the same apart from case, punctuation, spacing, order of sentences and at most one edit in
    EDIT_EVERY units of the longer one. Sentences of either text are laid along the other, so ends of sentences that an
    edit took away from one of them don't matter."""
    x, y = sentences(a), sentences(b)
    flat_x, flat_y = [w for s in x for w in s], [w for s in y for w in s]
    if not flat_x or not flat_y:
        return False
    k = max(len(flat_x), len(flat_y)) // EDIT_EVERY
    if sum((Counter(flat_x) & Counter(flat_y)).values()) < max(len(flat_x), len(flat_y)) - k:
        return False
    if banded(flat_x, flat_y, k):
        return True
    return len(x) > 1 and banded(_aligned(x, flat_y), flat_y, k) or len(y) > 1 and banded(flat_x, _aligned(y, flat_x), k)


def split_kinds(splits: DataFrame) -> DataFrame:
    """id, kind (train or eval), split of every id with a split; names are compared without case and outer blanks."""
    name = F.lower(F.regexp_replace("split", r"(?U)^\s+|\s+$", ""))
    rows = splits.where(~is_blank(F.col("split")) & F.col("id").isNotNull()).select("id", name.alias("split")).distinct()
    return rows.select("id", F.when(F.col("split") == "train", "train").otherwise("eval").alias("kind"), "split")


def cited_pairs(gold: DataFrame) -> DataFrame:
    """id, cites, one, other: each id once, with the key of its two cited sections in their order, and its texts in the
    same order. Where both sections are the same, both orders. Ids with a text or a citation missing are left out."""
    cols = ["source_framework", "source_citation_id", "target_framework", "target_citation_id", "source_mechanism", "target_mechanism"]
    first = gold.groupBy("id").agg(F.min(F.struct(*cols)).alias("r")).select("id", "r.*")
    a = F.concat("source_framework", F.lit("|"), cited_base(F.col("source_citation_id")))
    b = F.concat("target_framework", F.lit("|"), cited_base(F.col("target_citation_id")))
    rows = first.select("id", a.alias("a"), b.alias("b"), F.col("source_mechanism").alias("s"), F.col("target_mechanism").alias("t"))
    rows = rows.where(F.col("a").isNotNull() & F.col("b").isNotNull() & ~is_blank(F.col("s")) & ~is_blank(F.col("t")) & F.col("id").isNotNull())
    as_is, turned = F.struct(F.col("s").alias("one"), F.col("t").alias("other")), F.struct(F.col("t").alias("one"), F.col("s").alias("other"))
    orders = F.when(F.col("a") < F.col("b"), F.array(as_is)).when(F.col("a") > F.col("b"), F.array(turned)).otherwise(F.array(as_is, turned))
    return rows.select("id", F.concat(F.least("a", "b"), F.lit(SEP), F.greatest("a", "b")).alias("cites"), F.explode(orders).alias("o")).select("id", "cites", "o.one", "o.other")


def _emit(make, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, parts = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                made = make(text)
                row += [i] * len(made)
                parts += made
            at = pa.array(row, pa.int64())
            cols = [batch.column(0).take(at), batch.column(1).take(at), pa.array([p[0] for p in parts], pa.string())]
            cols += [pa.array([p[j] for p in parts], pa.int32()) for j in range(1, len(names) - 2)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(2, 6)]
        keep = pa.array([same_text(o1, o2) and same_text(p1, p2) for o1, p1, o2, p2 in zip(*cols)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["e", "t"])


def cross_split_pairs(gold: DataFrame, splits: DataFrame) -> DataFrame:
    """eval_id, train_id, split: records of an evaluation split that occur again in train, exactly or almost.

    Null or blank texts, citations and splits make no case; repeated rows count once; an id never pairs with itself.
    """
    kinds = split_kinds(splits)
    rows = cited_pairs(gold).join(kinds.select("id", "kind").distinct(), "id").withColumn("cls", F.xxhash64("cites", "one", "other"))
    shared = rows.groupBy("cites").agg(F.max((F.col("kind") == "train").cast("int")).alias("t"), F.max((F.col("kind") == "eval").cast("int")).alias("e")).where("t = 1 AND e = 1").select("cites")
    rows = cut_lineage(rows.join(shared, "cites", "left_semi"))
    classes = cut_lineage(rows.groupBy("cls", "kind").agg(F.first("cites").alias("cites"), F.first("one").alias("one"), F.first("other").alias("other")))
    ev, tr = classes.where("kind = 'eval'"), classes.where("kind = 'train'")
    probes = ev.select("cls", "cites", "one").mapInArrow(_emit(probe_rows, ["cls", "cites", "seg", "in_sentence", "in_text", "k"]), "cls long, cites string, seg string, in_sentence int, in_text int, k int")
    index = tr.select("cls", "cites", "one").mapInArrow(_emit(index_rows, ["cls", "cites", "seg", "in_sentence", "in_text"]), "cls long, cites string, seg string, in_sentence int, in_text int")
    key = lambda d, p: d.select(F.xxhash64("cites", "seg").alias("key"), *[F.col(c).alias(p + c) for c in d.columns if c not in ("cites", "seg")])
    hits = key(probes, "e_").join(key(index, "t_"), "key")
    near = (F.abs(F.col("e_in_sentence") - F.col("t_in_sentence")) <= F.col("e_k")) | (F.abs(F.col("e_in_text") - F.col("t_in_text")) <= F.col("e_k"))
    found = hits.where(near).select(F.col("e_cls").alias("e"), F.col("t_cls").alias("t")).distinct()
    text = lambda d, k, n: d.select(F.col("cls").alias(k), F.col("one").alias("one" + n), F.col("other").alias("other" + n))
    pairs = found.join(text(ev, "e", "1"), "e").join(text(tr, "t", "2"), "t").select("e", "t", "one1", "other1", "one2", "other2").mapInArrow(_check, "e long, t long")
    members = lambda k, out: rows.where(F.col("kind") == k).select(F.col("cls"), F.col("id").alias(out)).distinct()
    wide = pairs.join(members("eval", "eval_id").withColumnRenamed("cls", "e"), "e").join(members("train", "train_id").withColumnRenamed("cls", "t"), "t")
    named = kinds.where("kind = 'eval'").select(F.col("id").alias("eval_id"), "split")
    return wide.where("eval_id <> train_id").select("eval_id", "train_id").distinct().join(named, "eval_id").select("eval_id", "train_id", "split")


def overlap_report(pairs: DataFrame, gold: DataFrame, splits: DataFrame) -> DataFrame:
    """split, source_framework, records, overlapping: how many records of each evaluation split and source framework
    occur in train."""
    frameworks = gold.groupBy("id").agg(F.min("source_framework").alias("source_framework"))
    records = split_kinds(splits).where("kind = 'eval'").join(frameworks, "id")
    hit = pairs.select(F.col("eval_id").alias("id"), "split").distinct().withColumn("hit", F.lit(1))
    return records.join(hit, ["id", "split"], "left").groupBy("split", "source_framework").agg(F.count("*").alias("records"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("overlapping"))
