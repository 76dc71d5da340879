"""Substring dedup: recurring word passages are confirmed in Spark, compiled to sharded Aho-Corasick automata, located and removed.

A window is K consecutive words. Every word covered by a window that also starts in a document with a smaller doc_id goes.

1. Each batch of documents hashes its windows and sends each once, with its smallest doc_id, to the key group of its hash; of the
   other documents that have it only their shards. So a passage in a third of all rows costs one entry a batch and shard.
2. A key group finds the owner of each key, the smallest doc_id that has it, and which shards have it in larger ones: those keys recur.
3. Owners' texts give the passages: maximal runs of windows that a shard asks for, as words, from the owner alone.
4. Each shard takes its documents batch by batch: hashes choose the phrases of the passages that a batch may hold, one automaton is
   compiled of them, with the words of their owners, and the batch's documents are streamed through it. Each occurrence is found
   word by word; it counts in documents larger than the owner. Hashes only choose which words and documents meet: where two
   different windows have one hash, none is removed for the other.

Documents without a window that recurs in a smaller document keep all words and are not shuffled. Groups and shards grow in
number with spark.sql.shuffle.partitions and with the bytes of the texts; an automaton holds no more words than its batch.

Null texts have no words. A null doc_id counts as larger than every other. Rows that repeat a doc_id are each returned and
never remove words of each other. Documents of fewer than K words keep all. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from lumora.llm.common import NULL_ID, Words, by_bytes, by_ids, ids_of, joined, next_prime, partitions, release, split_by, staged, text_size, utf8, windows

K = 13
BATCH = 2 << 20  # bytes of text whose windows are hashed at once
GROUP_BYTES, LIST_BYTES, SHARD_BYTES = 8 << 20, 16 << 20, 4 << 20  # of text whose windows meet in a group, and that makes a list or a shard, at most about


def _keys(h: np.ndarray, text: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, group hash and first word of each window. bits: of the hash, fewer only in tests of equal hashes."""
    key, group, at = windows(h, text, k)
    if bits < 64:
        key, group = key & np.uint64((1 << bits) - 1), key & np.uint64((1 << bits) - 1)
    return key, group, at


def _pairs(a: np.ndarray, b: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Rows of the arrays without those that repeat a and b."""
    order = np.lexsort((b, a))
    own = [x[order] for x in (a, b, *more)]
    new = np.ones(len(a), bool)
    new[1:] = (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])
    return [x[new] for x in own]


def _blocks(groups: int, shards: int, lists: int, k: int, bits: int):
    """Batches of (doc_id, text) to blocks by key group: keys with their smallest documents, and keys with shards of larger ones.

    Bucket -1 - list holds documents that have a window of a smaller one in their batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            ids = ids_of(batch.column("doc_id"))
            order = np.argsort(ids, kind="stable")
            words = Words(batch.column("text").take(pa.array(order)))
            text = words.texts()
            key, group, at = _keys(words.hashes(), text, k, bits)
            doc = ids[order][text[at]]
            by_key = np.argsort(key, kind="stable")  # in each key by doc_id, as texts are
            new = np.ones(len(key), bool)
            new[1:] = key[by_key][1:] != key[by_key][:-1]
            smallest = np.empty(len(key), np.int64)
            smallest[by_key] = doc[by_key][new][np.cumsum(new) - 1]
            later = doc > smallest
            first = np.zeros(len(key), bool)  # in the order of documents, so that the doc_ids of a block compress
            first[by_key[new]] = True
            group = (group % np.uint64(groups)).astype(np.int64)
            out = [(b, k_, d, b"", b"") for b, k_, d in split_by(group[first], key[first], doc[first])]
            again, dest, of = _pairs(key[later], doc[later] % shards, group[later])
            out += [(b, b"", b"", k_, d) for b, k_, d in split_by(of, again, dest.astype(np.int32))]
            own = np.unique(doc[later])
            out += [(-1 - b, b"", d, b"", b"") for b, d in split_by(own % lists, own)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], BLOCKS)

    return run


BLOCKS = ["bucket", "keys", "docs", "again", "dests"]


def _dealt(blocks: DataFrame, n: int) -> GroupedData:
    """Blocks by bucket in n partitions, each with as many key groups: dealt by the hash of the bucket, some would hold several times the mean.

    A bucket goes by a number that Spark's hash deals to the partition of the bucket modulo n.
    """
    to = blocks.sparkSession.range(64 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("to")).groupBy("to").agg(F.min("id").alias("id")).orderBy("to").collect()
    number = F.array(*(F.lit(r["id"]).cast("long") for r in to))[F.pmod("bucket", F.lit(len(to)))]
    return blocks.withColumn("_part", number).repartition(n, "_part").groupBy("_part", "bucket")


CONFIRMED = "list int, owner boolean, docs binary, keys binary, dests binary"


def _confirm(shards: int, lists: int):
    """A key group to (owner, key, shard that asks for it) and to the larger documents, both by list: doc_id modulo `lists`."""

    def run(table: pa.Table) -> pa.Table:
        release()
        bucket = table.column("bucket")[0].as_py()
        docs = joined(table.column("docs"), np.int64)
        if bucket < 0:
            out = [(-1 - bucket, False, np.unique(docs).tobytes(), b"", b"")]  # the list of these
        else:
            keys, again, dests = joined(table.column("keys"), np.uint64), joined(table.column("again"), np.uint64), joined(table.column("dests"), np.int32)
            order = np.lexsort((docs, keys))
            docs, keys = docs[order], keys[order]
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            head, owner = keys[first], docs[first]
            later = docs > owner[np.cumsum(first) - 1]
            key, dest = _pairs(np.concatenate([keys[later], again]), np.concatenate([docs[later] % shards, dests.astype(np.int64)]))
            of = owner[np.searchsorted(head, key)]
            # in the order of owners, so that they compress
            order = np.argsort(of, kind="stable")
            of, key, dest = of[order], key[order], dest[order].astype(np.int32)
            own = np.unique(docs[later])
            out = [(b, True, d, k, x) for b, d, k, x in split_by(of % lists, of, key, dest)]
            out += [(b, False, d, b"", b"") for b, d in split_by(own % lists, own)]
        types = [pa.int32(), pa.bool_(), *[pa.binary()] * 3]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 5, types, strict=True)], ["list", "owner", "docs", "keys", "dests"])

    return run


def _ids(table: pa.Table) -> pa.Table:
    """The documents of a list, each once."""
    release()
    return pa.table({"_id": pa.array(np.unique(joined(table.column("docs"), np.int64)))})


def runs(at: np.ndarray, text: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(first word, word after the last) of each maximal run of windows, given by their first words."""
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(text[at]) != 0)) + 1
    return list(zip(at[np.concatenate([[0], cut])].tolist(), (at[np.concatenate([cut - 1, [len(at) - 1]])] + k).tolist(), strict=True))


def _slices(table: pa.Table, column: str, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    yield from by_bytes(iter(table.combine_chunks().to_batches()), column, most)


def _passages(k: int, bits: int):
    """Owners' texts and what is asked of them to (dest, owner, passage): words joined by one space."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        release()
        out: list[tuple[int, int, bytes]] = []
        if asked.num_rows and docs.num_rows:
            doc, key, dest = (joined(asked.column(c), t) for c, t in (("docs", np.int64), ("keys", np.uint64), ("dests", np.int32)))
            order = np.lexsort((key, doc))
            doc, key, dest = doc[order], key[order], dest[order]
            begin = np.searchsorted(doc, doc, "left")
            for batch in _slices(docs, "text"):
                ids, words = ids_of(batch.column("doc_id")), Words(batch.column("text"))
                text = words.texts()
                mine, _, at = _keys(words.hashes(), text, k, bits)
                own, raw = words.first, words.data.tobytes()
                window = np.searchsorted(at, own)  # of each text, with the end
                for t in range(batch.num_rows):
                    a, b = np.searchsorted(doc, ids[t], "left"), np.searchsorted(doc, ids[t], "right")
                    if a == b:
                        continue
                    keys, place = mine[window[t] : window[t + 1]], at[window[t] : window[t + 1]]
                    for d in np.unique(dest[a:b]).tolist():
                        wanted = key[a:b][dest[a:b] == d]  # sorted
                        hit = wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys
                        for x, y in runs(place[hit], text, k):
                            out.append((d, int(ids[t]), b" ".join(raw[words.starts[i] : words.ends[i]] for i in range(x, y))))
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["dest", "owner", "passage"])

    return run


def _spelled(words: Words) -> pa.Array:
    """The words of a batch as binary values."""
    offsets = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words.data[words._word]))])


class Automata:
    """Passages with their owners, and the automata that find them in batches of documents."""

    def __init__(self, passages: pa.Array, owners: np.ndarray, k: int, bits: int = 64):
        words = Words(passages.cast(pa.large_string()))
        coded, text = _spelled(words).dictionary_encode(), words.texts()
        self.known, self.k, self.bits = coded.dictionary, k, bits
        self.number = coded.indices.to_numpy().astype(np.int64) + 1
        # windows in the order of their hashes, which say what of the passages a batch may hold
        key, _, self.at = _keys(words.hashes(), text, k, bits)
        self.text, self.owner = text[self.at], owners[text[self.at]]
        self.order = np.lexsort((self.owner, key))  # of equal ones the smallest owner first
        self.key = key[self.order]

    def numbers(self, words: Words) -> np.ndarray:
        """The words of documents as numbers; 0 for a word that no passage has."""
        return pc.fill_null(pc.index_in(_spelled(words), value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def _mark(self, mask: np.ndarray, spans: list[tuple[int, int, int]], docs: np.ndarray, ids: np.ndarray, first: np.ndarray, number: np.ndarray) -> None:
        """Compile the phrases (first word and word after the last in the passages, owner) and count what they cover in the documents."""
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, (x, y, _) in enumerate(spans):
            automaton.add_word(tuple(self.number[x:y].tolist()), i)
        automaton.make_automaton()
        for t in docs.tolist():
            a, own = int(first[t]), int(ids[t])
            for end, i in automaton.iter(tuple(number[a : first[t + 1]].tolist())):
                x, y, owner = spans[i]
                if owner < own:
                    mask[a + end + 1 - (y - x)] += 1
                    mask[a + end + 1] -= 1

    def covered(self, ids: np.ndarray, words: Words) -> np.ndarray:
        """By word of the documents, whether an occurrence of a smaller owner's phrase covers it."""
        k, text, n = self.k, words.texts(), len(words.starts)
        mask = np.zeros(n + 1, np.int64)
        key, _, at = _keys(words.hashes(), text, k, self.bits)
        if not len(self.key) or not len(key):
            return mask[:-1] > 0
        w = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[w] == key
        w = self.order[w]
        hit &= self.owner[w] < ids[text[at]]
        at, w = at[hit], w[hit]
        if not len(at):
            return mask[:-1] > 0
        number = self.numbers(words)
        # windows that follow each other in a document and in a passage are one phrase, spelled as its owner spells it
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(text[at]) != 0) | (np.diff(w) != 1) | (np.diff(self.at[w]) != 1) | (np.diff(self.text[w]) != 0)) + 1
        begin, end = w[np.concatenate([[0], cut])], w[np.concatenate([cut - 1, [len(w) - 1]])]
        phrases = np.unique(np.stack([begin, end]), axis=1)
        spans = list(zip(self.at[phrases[0]].tolist(), (self.at[phrases[1]] + k).tolist(), self.owner[phrases[0]].tolist(), strict=True))
        self._mark(mask, spans, np.unique(text[at]), ids, words.first, number)
        # a window of equal hash that no phrase covers: other words, or part of a run with some; each alone
        total = np.concatenate([[0], np.cumsum(np.cumsum(mask[:-1]) > 0)])
        open_ = total[at + k] - total[at] < k
        if open_.any():
            single = np.unique(w[open_])
            spans = list(zip(self.at[single].tolist(), (self.at[single] + k).tolist(), self.owner[single].tolist(), strict=True))
            self._mark(mask, spans, np.unique(text[at[open_]]), ids, words.first, number)
        return np.cumsum(mask[:-1]) > 0


def _rows(batch: pa.RecordBatch, words: Words, gone: np.ndarray, clean: bool) -> dict[str, pa.Array]:
    total = np.concatenate([[0], np.cumsum(gone)])
    data, off = utf8(batch.column("text"))
    kept, cleaned = [], []
    for t in range(batch.num_rows):
        raw = data[off[t] : off[t + 1]]
        own = raw.tobytes().split()
        a, b = words.first[t], words.first[t + 1]
        if total[b] > total[a]:
            own = [w for w, g in zip(own, gone[a:b].tolist(), strict=True) if not g]
        kept.append(b" ".join(own).decode())
        if clean:
            cleaned.append(cut_out(raw, words.starts[a:b] - off[t], words.ends[a:b] - off[t], gone[a:b]))
    out = {"n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64()), "kept_text": pa.array(kept, pa.string())}
    return out | ({"clean_text": pa.array(cleaned, pa.string())} if clean else {})


def cut_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> str:
    """A text without the words that are gone and the white space behind them; the rest as it is."""
    if not gone.any():
        return data.tobytes().decode()
    edge = np.zeros(len(data) + 1, np.int64)
    edge[starts[gone]] += 1
    np.add.at(edge, np.append(starts[1:], len(data))[gone], -1)
    keep = np.cumsum(edge)[:-1] == 0
    return data[keep].tobytes().decode().rstrip()


def _remove(k: int, bits: int, clean: bool, names: list[str]):
    """A shard's documents and passages to rows."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        release()
        # equal passages of one owner are one
        own = found.select(["owner", "passage"]).group_by(["owner", "passage"]).aggregate([])
        automata = Automata(own.column("passage").combine_chunks(), own.column("owner").to_numpy(), k, bits)
        out = []
        for batch in _slices(docs, "text"):
            words = Words(batch.column("text"))
            gone = automata.covered(ids_of(batch.column("doc_id")), words)
            made = _rows(batch, words, gone, clean)
            out.append(pa.table([made[c] if c in made else batch.column(c) for c in names], names))
        return pa.concat_tables(out)

    return run


def _keep(clean: bool, names: list[str]):
    """Rows of documents that keep all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            words = Words(batch.column("text"))
            made = _rows(batch, words, np.zeros(len(words.starts), bool), clean)
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)

    return run


def dedup(docs: DataFrame, k: int = K, clean: bool = False, bits: int = 64) -> DataFrame:
    """The columns of docs but text, with n_words, n_removed and kept_text (the kept words joined by one space).

    clean: also clean_text, the text with only the removed words and the white space behind them cut out.
    """
    n = partitions(docs.sparkSession)
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, size = text_size(pairs)
    groups, shards, lists = n * max(1, -(-size // (n * GROUP_BYTES))), next_prime(max(2 * n, size // SHARD_BYTES)), next_prime(max(n, size // LIST_BYTES))
    blocks = pairs.mapInArrow(_blocks(groups, shards, lists, k, bits), "bucket int, keys binary, docs binary, again binary, dests binary")
    confirmed = staged(_dealt(blocks, n).applyInArrow(_confirm(shards, lists), CONFIRMED), "confirmed")
    owners, later = (staged(confirmed.where(F.col("owner") == o).select("list", "docs").groupBy("list").applyInArrow(_ids, "_id long"), "ids") for o in (True, False))

    def part(id_: Column, parts: int) -> Column:
        return F.pmod(F.coalesce(id_.cast("long"), F.lit(int(NULL_ID))), F.lit(parts)).cast("int")

    own = by_ids(pairs, owners, "left_semi").withColumn("_list", part(F.col("doc_id"), lists)).groupBy("_list")
    found = own.cogroup(confirmed.where("owner").groupBy("list")).applyInArrow(_passages(k, bits), "dest int, owner long, passage binary")
    left = docs.drop("n_words", "n_removed", "kept_text", "clean_text", "_shard", "_id")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields if f.name != "text"] + ["n_words long", "n_removed long", "kept_text string", *(["clean_text string"] if clean else [])]
    names = [*(c for c in left.columns if c != "text"), "n_words", "n_removed", "kept_text", *(["clean_text"] if clean else [])]
    some = by_ids(left, later, "left_semi").withColumn("_shard", part(F.col("doc_id"), shards)).groupBy("_shard")
    out = some.cogroup(staged(found, "passages").groupBy("dest")).applyInArrow(_remove(k, bits, clean, names), ", ".join(fields))
    return out.union(by_ids(left, later, "left_anti").mapInArrow(_keep(clean, names), ", ".join(fields)))
