"""Exact Jaccard join of documents on word shingles by T-occurrence search with DivideSkip.

Two documents link when their sets of shingles have 100 * intersection >= SIMILARITY * union.

1. Shared shingles. Each batch hashes its documents' shingles; those that it holds in several documents are known to be
   shared, the others go, once a batch, to their key group, which tells whether another document has them. A document with
   fewer shared shingles than the similarity asks for links with nothing and is done: its text is not read again.
2. The rest become classes of equal sets. A class of n shingles needs T = ceil(n * SIMILARITY / 100) of them in its partner:
   of its shingles by rising number of classes, the first n - T + 1 (the short lists) hold one that the partner has too.
3. A short list belongs to the cell of its smallest class. Classes that share a short list share its cell, so all links lie
   inside cells; near copies have the same smallest class in most of their lists, so a class is in few cells.
4. Each cell is an index of inverted lists. The sets whose shingles are most frequent are searched first; then each class that is
   not connected with the largest group yet. A search is T-occurrence by DivideSkip: short lists are merged and what cannot occur
   often enough is skipped, long lists are held as bits and probed by counting them, candidates with the required overlap link.
   Only links that connect something leave the cell, at most one less than its classes: no pairs are made.
5. A cell of more than CELL_BYTES is dealt by hash to parts, each with the smallest class in it. Afterwards, classes
   of such a cell that are not connected with its smallest one are searched in the other parts too, in blocks.

Null texts and texts without words have no shingles and link with nothing. Texts of fewer words than a shingle are one
shingle. Rows that repeat a doc_id are judged by their own text. A null doc_id is returned, and is the component only if
all its documents have none. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import _COEF, NULL_ID, Words, by_bytes, by_ids, ids_of, joined, mix, next_prime, partitions, release, split_by, staged, text_size, windows
from lumora.llm.components import components

K = 5
SIMILARITY = 75  # per cent
BATCH = 2 << 20  # bytes of text whose shingles are hashed at once: a worker's memory is some 40 times that
GROUP_BYTES = 8 << 20  # of text whose shingles meet in one key group, at most about
CELL_BYTES = 32 << 20  # of shingles in one cell or part of a cell
LONG = 512  # sets in a list that is probed rather than merged: a probe by binary search costs as much as some hundred steps of the merge
WIDE = 64  # lists of more than one in so many sets of a cell are held as bits
FIRST = 4  # sets of a cell that are searched whatever is connected


def shingles(column, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) of a batch in the order of texts, and their order by shingle."""
    words = Words(column, lower=True)
    h, text = words.hashes(), words.texts()
    key, _, at = windows(h, text, k, second=False)
    own = text[at]
    for n in range(1, k):  # a short text's whole sequence, told from windows by its length
        few = np.flatnonzero(words.counts == n)
        if len(few):
            s = np.zeros(len(few), np.uint64)
            for j in range(n):
                s += h[words.first[few] + j] * _COEF[j]
            key, own = np.concatenate([key, mix(s + _COEF[200 + n])]), np.concatenate([own, few])
    if len(own) > len(at):
        order = np.argsort(own, kind="stable")
        key, own = key[order], own[order]
    # one sort for both: equal shingles meet, then those of a text, as texts rise with the place
    order = np.argsort(key)
    ordered = key[order]
    equal = np.zeros(len(key) + 1, bool)
    equal[1:-1] = ordered[1:] == ordered[:-1]
    run = np.flatnonzero(equal[1:] | equal[:-1])
    order[run] = order[run][np.lexsort((order[run], ordered[run]))]
    new = np.ones(len(key), bool)
    new[1:] = ~(equal[1:-1] & (own[order[1:]] == own[order[:-1]]))
    order = order[new]
    kept = np.zeros(len(key), bool)
    kept[order] = True
    return own[kept], key[kept], (np.cumsum(kept) - 1)[order]


def _blocks(groups: int, shards: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            ids = ids_of(batch.column("doc_id"))
            text, key, order = shingles(batch.column("text"), k)
            new = np.ones(len(key), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            size = np.diff(np.append(np.flatnonzero(new), len(key)))
            several, first = np.zeros(len(key), bool), np.zeros(len(key), bool)
            several[order] = np.repeat(size > 1, size)
            first[order[new]] = True
            group = (mix(key ^ _COEF[7]) % np.uint64(groups)).astype(np.uint16 if groups <= 1 << 16 else np.int64)  # numpy sorts 16 bits by radix
            # in a group, 32 bits of a key: two keys that agree in them only let a document through that has no partner.
            # Groups grow in number with the data, so their share stays the same. Entries stay in the order of documents, which compresses
            low = key.astype(np.uint32)
            one, more = first & ~several, first & several
            out = [(b, d, x, b"") for b, x, d in split_by(group[one], low[one], ids[text[one]])]
            out += [(b, b"", b"", x) for b, x in split_by(group[more], low[more])]
            known, n = np.bincount(text[several], minlength=len(ids)).astype(np.int64), np.bincount(text, minlength=len(ids)).astype(np.int64)
            out += [(-1 - b, d, c, x) for b, d, c, x in split_by(ids % shards, ids, known, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "docs", "keys", "shared"])

    return run


COUNTS = "shard int, docs binary, counts binary, sizes binary"


def _shared(shards: int):
    """A key group to (documents, their shared shingles) by shard; a shard's own rows (bucket -1 - shard) pass."""

    def run(table: pa.Table) -> pa.Table:
        release()
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            cols = [[-1 - bucket] * table.num_rows, *(table.column(c) for c in ("docs", "keys", "shared"))]
        else:
            docs, keys, known = joined(table.column("docs"), np.int64), joined(table.column("keys"), np.uint32), joined(table.column("shared"), np.uint32)
            _, number, count = np.unique(np.concatenate([keys, known]), return_inverse=True, return_counts=True)
            doc, n = np.unique(docs[count[number[: len(keys)]] > 1], return_counts=True)
            out = [(*x, b"") for x in split_by(doc % shards, doc, n.astype(np.int64))]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(cols[0], pa.int32()), *(c if isinstance(c, pa.ChunkedArray) else pa.array(c, pa.binary()) for c in cols[1:])], ["shard", "docs", "counts", "sizes"])

    return run


def _able(similarity: int):
    """All counts of a shard's documents to (doc_id, n_shingles, able): whether as many shingles are shared as a link needs."""

    def run(table: pa.Table) -> pa.Table:
        release()
        doc, inverse = np.unique(joined(table.column("docs"), np.int64), return_inverse=True)
        shared = np.bincount(inverse, joined(table.column("counts"), np.int64), len(doc)).astype(np.int64)
        own = table.filter(pa.array([len(x) > 0 for x in table.column("sizes").to_pylist()], pa.bool_()))
        ids, n = joined(own.column("docs"), np.int64), joined(own.column("sizes"), np.int64)
        able = (n > 0) & (100 * shared[np.searchsorted(doc, ids)] >= similarity * n)
        able = np.isin(ids, ids[able])  # rows of one doc_id go together
        return pa.table({"doc_id": pa.array(ids, mask=ids == NULL_ID), "n_shingles": pa.array(n), "able": pa.array(able)})

    return run


SETS = "doc_id long, n_shingles long, node long, shingles array<long>"


def _sets(k: int):
    """Documents to SETS; node is the hash of the set. A text without shingles has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            text, key, _ = shingles(batch.column("text"), k)
            n = np.bincount(text, minlength=batch.num_rows).astype(np.int64)
            end = np.cumsum(n)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key ^ _COEF[9]))])
            node = mix(sums[end] - sums[end - n] + n.astype(np.uint64) * _COEF[11]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(node, mask=n == 0), lists], ["doc_id", "n_shingles", "node", "shingles"])

    return run


def merge_skip(lists: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """(candidate, count) of those that occur in at least `least` of the sorted lists.

    Such a one is in the shortest of the lists, all but least - 1: these are merged, and whatever the others hold beside is skipped.
    """
    if least > len(lists):
        return []
    lists = sorted(lists, key=len)
    doc, count = np.unique(np.concatenate(lists[: len(lists) - least + 1]), return_counts=True)
    if least > 1 and len(doc):
        rest = np.concatenate(lists[len(lists) - least + 1 :])
        at = np.minimum(np.searchsorted(doc, rest), len(doc) - 1)
        count = count + np.bincount(at[doc[at] == rest], minlength=len(doc))
    found = count >= least
    return list(zip(doc[found].tolist(), count[found].tolist(), strict=True))


def t_occurrence(lists: list[np.ndarray], needed: np.ndarray, least: int, held: int = 0, bits=None) -> np.ndarray:
    """Candidates that occur in as many of the sorted lists as each needs; `least` is the smallest of these numbers.

    DivideSkip: the longest lists are probed, the others merged. `held` lists more are in an index as bits; bits(candidates)
    counts how many of them each is in. The rest of the long ones is probed by binary search.
    """
    if len(lists) + held < least or least < 1:
        return np.zeros(0, np.int64)
    lists = sorted(lists, key=len)
    long = max(0, min(least - held - 1, sum(len(x) > LONG for x in lists)))
    cut = len(lists) - long
    if held < least:
        merged = merge_skip(lists[:cut], least - held - long)
        doc, count = (np.array(c, np.int64) for c in zip(*merged, strict=True)) if merged else (np.zeros(0, np.int64),) * 2
    else:  # to be in the long lists is enough
        doc = np.flatnonzero(needed <= held + len(lists))
        count = np.bincount(np.concatenate(lists), minlength=len(needed))[doc] if lists else np.zeros(len(doc), np.int64)
    for left, probe in zip(range(long + held, held, -1), lists[cut:], strict=True):
        keep = count + left >= needed[doc]
        if not keep.all():
            doc, count = doc[keep], count[keep]
        if not len(doc):
            return doc
        count = count + (probe[np.minimum(np.searchsorted(probe, doc), len(probe) - 1)] == doc)
    if held:
        keep = count + held >= needed[doc]
        doc, count = doc[keep], count[keep]
        count = count + bits(doc)
    return doc[count >= needed[doc]]


class Index:
    """Inverted lists of the sets of a cell; `connected` numbers what is linked already.

    A list of more than one in WIDE of the sets is a bit of each set, so that to probe all such lists is to count common bits.
    Shorter ones are lists of sets. least_df: still shorter lists are not needed.
    """

    def __init__(self, sets: pa.ChunkedArray, connected: np.ndarray, least_df: int = 1):
        flat = sets.combine_chunks()
        flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
        key, self.size = flat.flatten().to_numpy(), np.diff(flat.offsets.to_numpy()).astype(np.int64)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.head = np.flatnonzero(new)
        self.token, self.length = ordered[self.head], np.diff(np.append(self.head, len(ordered)))
        del ordered, key
        owner = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        self.owner, self.end, self.connected = owner[order], np.cumsum(self.size), connected
        self.own = np.empty(len(order), np.int32)  # by set, its tokens
        self.own[order] = np.repeat(np.arange(len(self.head), dtype=np.int32), self.length)
        wide = (self.length >= least_df) & (self.length * WIDE > len(self.size))
        self.bit = np.where(wide, np.cumsum(wide) - 1, -1)
        self.short = ~wide & (self.length >= least_df)
        self.words = -(-int(wide.sum()) // 64)
        self.bits = self._rows(owner, self.own, len(self.size))

    def _rows(self, row: np.ndarray, token: np.ndarray, rows: int) -> np.ndarray:
        """The bits of each row's tokens."""
        out = np.zeros(rows * self.words, np.uint64)
        bit = self.bit[token]
        some = bit >= 0
        at = np.sort(row[some].astype(np.int64) * (64 * self.words) + bit[some])
        if len(at):
            first = np.flatnonzero(np.concatenate([[True], (at[1:] >> 6) != (at[:-1] >> 6)]))
            out[at[first] >> 6] = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
        return out.reshape(rows, self.words)

    def mean_df(self) -> np.ndarray:
        """By set, how many sets a shingle of it is in on average."""
        total = np.concatenate([[0], np.cumsum(self.length[self.own])])[self.end]
        return np.diff(total, prepend=0) / self.size

    def search_own(self, i: int, similarity: int, skip: np.ndarray) -> np.ndarray:
        """Sets that link with the set i; skip: those that need not be found."""
        n = int(self.size[i])
        return self._search(self.own[self.end[i] - n : self.end[i]], self.bits[i], n, similarity, skip)

    def search(self, query: np.ndarray, similarity: int, skip: np.ndarray) -> np.ndarray:
        """Sets that link with a query; skip: those that need not be found."""
        at = np.minimum(np.searchsorted(self.token, query), len(self.token) - 1)
        at = at[self.token[at] == query]
        return self._search(at, self._rows(np.zeros(len(at), np.int64), at, 1)[0], len(query), similarity, skip)

    def _search(self, tokens: np.ndarray, row: np.ndarray, n: int, similarity: int, skip: np.ndarray) -> np.ndarray:
        needed = -(-similarity * (n + self.size) // (100 + similarity))
        needed[skip] = np.iinfo(np.int64).max
        short, held = tokens[self.short[tokens]], int(np.bitwise_count(row).sum())
        lists = [self.owner[b : b + m] for b, m in zip(self.head[short].tolist(), self.length[short].tolist(), strict=True)]
        return t_occurrence(lists, needed, -(-similarity * n // 100), held, lambda doc: np.bitwise_count(self.bits[doc] & row).sum(1, dtype=np.int64))

    def connect(self, label: int, found: np.ndarray) -> np.ndarray:
        """Give all that is connected with `found` the label; one of found for each other label."""
        other = self.connected[found]
        labels, first = np.unique(other, return_index=True)
        fresh = labels != label
        self.connected[np.isin(self.connected, labels)] = label
        return found[first[fresh]]


def _links(u: list[int], v: list[int]) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _search(similarity: int):
    """The classes of a cell (or a part of one) to links that connect all of them that are connected."""

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows > 1000:
            release()
        names, index = table.column("node").to_numpy(), Index(table.column("shingles"), np.arange(table.num_rows), 2)
        done, u, v = np.zeros(len(names), bool), [], []

        def look(i: int) -> None:
            # those searched before would have found this one
            found = index.search_own(i, similarity, done | (index.connected == index.connected[i]))
            linked = index.connect(int(index.connected[i]), found)
            u.extend([int(names[i])] * len(linked))
            v.extend(names[linked].tolist())
            done[i] = True

        # from the middle outwards: what is connected with the largest group by then is found by the others
        order = np.lexsort((names, -index.mean_df())).tolist()
        for i in order[:FIRST]:
            look(i)
        label, count = np.unique(index.connected, return_counts=True)
        middle = int(np.flatnonzero(index.connected == label[np.argmax(count)])[0])
        for i in order[FIRST:]:
            if index.connected[i] != index.connected[middle]:
                look(i)
        return _links(u, v)

    return run


def _search_block(similarity: int):
    """A part of a cell and a block of queries from other parts, both with labels of what is connected, to links."""

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        u, v = [], []
        if members.num_rows and queries.num_rows:
            names = members.column("node").to_numpy()
            _, labels = np.unique(np.concatenate([members.column("label").to_numpy(), queries.column("q_label").to_numpy()]), return_inverse=True)
            index = Index(members.column("shingles"), labels[: len(names)].copy())
            for node, x, label in zip(queries.column("q_node").to_pylist(), queries.column("q_shingles"), labels[len(names) :].tolist(), strict=True):
                found = index.search(x.values.to_numpy(), similarity, index.connected == label)
                linked = index.connect(label, found)
                u += [node] * len(linked)
                v += names[linked].tolist()
        return _links(u, v)

    return run


def _cells(classes: DataFrame, similarity: int) -> DataFrame:
    """(cell, node, n_shingles): the classes that share a short list with the smallest class of the list."""
    tokens = classes.select("node", F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = tokens.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    ranked = ranked.join(classes.select("node", "n_shingles"), "node")
    # shingles of no other class come first in the order; they hold no partner, so only the rest of the short lists is kept
    short = F.col("n_shingles") - F.ceil(F.col("n_shingles") * similarity / 100) + 1 - (F.col("n_shingles") - F.size("t"))
    lists = ranked.where(short > 0).select("node", "n_shingles", F.explode(F.slice("t", F.lit(1), short.cast("int"))).alias("t")).select("node", "n_shingles", F.col("t.token").alias("token"))
    lists = staged(lists, "lists")
    lead = lists.groupBy("token").agg(F.min("node").alias("cell"), F.count(F.lit(1)).alias("n")).where("n > 1").select("token", "cell")
    return staged(lists.join(lead, "token").select("cell", "node", "n_shingles").distinct(), "cells")


def _cross(dealt: DataFrame, sets: DataFrame, labels: DataFrame, similarity: int, most: int) -> DataFrame:
    """Links between parts of cells; dealt(cell, part, parts, node): the classes of cells that have several parts."""
    known = dealt.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lead = known.where("node = cell").select("cell", F.col("label").alias("lead")).distinct()
    known = known.join(lead, "cell")
    open_ = known.where("node <> cell and label <> lead")
    blocks = open_.join(sets.select("node", "n_shingles"), "node").groupBy("cell").agg(F.ceil(8 * F.sum("n_shingles") / most).cast("int").alias("blocks"))
    asking = open_.join(blocks, "cell").select("cell", "part", "node", "label", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    asking = asking.where("p <> part").select("cell", F.col("p").alias("part"), "block", "node", "label")
    members = known.where("node <> cell").join(blocks, "cell").select("cell", "part", "node", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asking = asking.select(*(F.col(c).alias(f"q_{c}") for c in ("cell", "part", "block", "node", "label")))
    left = members.join(sets.select("node", "shingles"), "node").groupBy("cell", "part", "block")
    right = asking.join(sets.select(F.col("node").alias("q_node"), F.col("shingles").alias("q_shingles")), "q_node").groupBy("q_cell", "q_part", "q_block")
    return left.cogroup(right).applyInArrow(_search_block(similarity), "u long, v long")


def links_of(classes: DataFrame, similarity: int, most: int = CELL_BYTES) -> DataFrame:
    """classes(node, n_shingles, shingles) to links (u, v) that connect all nodes that are connected."""
    cells = _cells(classes, similarity)
    # few cells are so large: the written table of them is broadcast by Spark if it is small
    large = staged(cells.groupBy("cell").agg(F.ceil(8 * F.sum("n_shingles") / most).cast("int").alias("parts")).where("parts > 1"), "large")
    dealt = cells.join(large, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = dealt.where("node <> cell or parts = 1").select("cell", "part", "node").union(large.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("cell").alias("node")))
    links = staged(rows.join(classes.select("node", "shingles"), "node").groupBy("cell", "part").applyInArrow(_search(similarity), "u long, v long"), "links")
    if large.isEmpty():
        return links
    labels = staged(components(links).select("node", F.col("component").alias("label")), "labels")
    more = _cross(dealt.where("parts > 1").select("cell", "part", "parts", "node"), classes, labels, similarity, most)
    return links.union(staged(more, "cross"))


def similar(docs: DataFrame, k: int = K, similarity: int = SIMILARITY, most: int = CELL_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of each row."""
    n = partitions(docs.sparkSession)
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    count, size = text_size(pairs)
    groups, shards = max(2 * n, -(-size // GROUP_BYTES)), next_prime(max(n, count // 500_000))
    blocks = pairs.mapInArrow(_blocks(groups, shards, k), "bucket int, docs binary, keys binary, shared binary")
    counts = blocks.groupBy("bucket").applyInArrow(_shared(shards), COUNTS)
    counts = staged(counts.groupBy("shard").applyInArrow(_able(similarity), "doc_id long, n_shingles long, able boolean"), "counts")

    # only texts that may link are read again
    chosen = staged(counts.where("able").select(F.coalesce("doc_id", F.lit(int(NULL_ID))).alias("_id")).distinct(), "able")
    again = by_ids(pairs, chosen, "left_semi")
    rows = staged(again.mapInArrow(_sets(k), SETS), "sets")
    classes = rows.where("node is not null").groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("doc_id"))
    classes = staged(classes, "classes")
    labels = components(links_of(classes, similarity, most)).select("node", F.col("component").alias("label"))
    by_node = staged(classes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labels")
    least = by_node.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = by_node.join(least, "label").select("node", "component_id")
    out = rows.join(found, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.union(counts.where("not able").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
