"""Substring deduplication with suffix arrays, in bytes.

A string is LENGTH consecutive bytes of one document. A byte stays unless a string that covers it starts earlier too.

1. Shards. Consecutive documents make shards of about SHARD bytes; a document is never parted. Each shard sorts all its suffixes
   by Larsson-Sadakane refinement: the order by a few characters is refined to twice as many, by the ranks that stand so much
   further on, until every suffix is alone; only those that aren't yet are sorted again. A document ends with a
   mark that is like no other, so neither order nor prefixes cross documents.
2. Common prefixes, by Kasai's rule: where the characters before two neighbours are equal, the prefix is the one of the position before,
   less one. So only the other positions are compared, in words of eight bytes. Neighbours that share LENGTH bytes or more
   are the same string; all but the first of a shard go.
3. Merging. What is left is looked up across shards. Every string has an anchor, the run of GRAM bytes in it with the smallest hash, so
   equal strings have equal anchors, and neighbours mostly share theirs. Strings whose anchor occurs in two shards meet by anchor, with their
   bytes; there the strings of all shards are sorted once, and each is found in that order by binary search, which
   gives the first document that has it.
4. Hot anchors. A passage of very many documents is in one record for each shard, not for each document. Where
   an anchor still has over MOST records, they are dealt in parts by document, which drops repeats within a part; the rest is
   anchored by longer runs and dealt again. The last runs are the strings themselves, whose first document is an ordinary aggregate.
5. Removal. The runs that go are gathered by document.

Strings are told apart by the 64-bit hashes of the string and of its anchor together.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; a row with a null id is only held against itself;
rows that repeat an id are no earlier than each other. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, binaries, ceil_div, discard, mixed, saved, sliced

LENGTH, GRAM = 100, 32
#: Bytes of a shard with its marks: a processor's cache holds the ranks, and two of them and a place fit into one word, which is sorted as it is.
SHARD = (1 << 19) - 1
#: Records of an anchor, or bytes of many anchors, that are merged together.
MOST, BUCKET_BYTES = 20_000, 1_000_000
#: The end of a document. UTF-8 has no such byte.
END = 0xFF

#: A fixed value for each byte, for the hashes of strings.
BYTE_HASHES = mixed(np.arange(1, 257, dtype=np.uint64))


def first_order(data: np.ndarray, last: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """(sorted words, how many characters they hold): a suffix's first characters, nothing behind an END, and its place in the low bits."""
    used = np.zeros(256, dtype=bool)
    used[data] = True
    wide = int(used.sum()).bit_length()
    one = np.cumsum(used).astype(np.uint32)[data]
    depth = max(1, (63 - bits) // wide)
    # two characters, four, and so on up to depth
    key, have = one, 1
    while have < depth:
        step = min(have, depth - have)
        kind = np.uint32 if (have + step) * wide <= 32 else np.uint64
        key = key.astype(kind, copy=False)
        more = key >> kind(wide * (have - step)) if step < have else key  # the first `step` characters
        key = key << kind(wide * step)
        key[:-have] |= more[have:]
        have += step
    ends = np.flatnonzero(data == END)
    for d in range(min(depth - 1, len(data))):
        at = ends[ends >= d] - d
        at = at[last[at] == at + d]
        low = wide * (depth - d - 1)
        key[at] = (key[at] >> key.dtype.type(low)) << key.dtype.type(low)
    key = key.astype(np.uint64) << np.uint64(bits)
    key |= np.arange(len(data), dtype=np.uint64)
    key.sort()
    return key, depth


def suffix_array(data: np.ndarray, last: np.ndarray, packed_bits: int = 21) -> np.ndarray:
    """The order of all suffixes of documents that each end with END; last[i] is where the document of i ends. Equal ends rank by
    place. Up to 2**packed_bits positions, what is sorted is (rank, rank further on, place) in one word."""
    n = len(data)
    bits = max(1, n.bit_length())
    low = np.uint64((1 << bits) - 1)
    key, depth = first_order(data, last, bits)
    order = (key & low).astype(np.int64)
    key >>= np.uint64(bits)
    alone = np.ones(n + 1, dtype=bool)  # unlike the one before; a place more for the last
    np.not_equal(key[1:], key[:-1], out=alone[1:-1])
    head = np.arange(n)
    head *= alone[:-1]
    np.maximum.accumulate(head, out=head)
    rank = np.zeros(2 * n, dtype=np.int32)
    rank[order] = head
    open_ = np.flatnonzero(~(alone[:-1] & alone[1:]))
    head = head[open_]
    s = order[open_]
    left = (last - np.arange(n)).astype(np.int32)
    while len(open_):
        second = rank[s + min(depth, n)]
        short = left[s] < depth
        if short.any():
            second = np.where(short, s, second)
        if 3 * bits <= 63 and n <= 1 << packed_bits:
            word = ((head << (2 * bits)) | (second.astype(np.int64) << bits) | s).view(np.uint64)
            word.sort()
            s = (word & low).astype(np.int64)
            word >>= np.uint64(bits)
        else:
            word = (head.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
            by = np.argsort(word, kind="stable")
            s, word = s[by], word[by]
        order[open_] = s
        alone = np.ones(len(s) + 1, dtype=bool)
        np.not_equal(word[1:], word[:-1], out=alone[1:-1])
        head = open_ * alone[:-1]
        np.maximum.accumulate(head, out=head)
        rank[s] = head
        stay = np.flatnonzero(~(alone[:-1] & alone[1:]))
        open_, head, s = open_[stay], head[stay], s[stay]
        depth *= 2
    return order


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, the first one highest; zeros after the end."""
    out = np.zeros(len(data) + 8, dtype=np.uint64)
    out[: len(data)] = data
    for k in (1, 2, 4):
        out[:-k] = (out[:-k] << np.uint64(8 * k)) | out[k:]
    return out[: len(data)]


def bytes_alike(x: np.ndarray) -> np.ndarray:
    """How many leading bytes of each word are zero."""
    n = np.zeros(len(x), dtype=np.int64)
    for k in (32, 16, 8):
        none = x < (np.uint64(1) << np.uint64(64 - k))
        n += np.where(none, k // 8, 0)
        x = np.where(none, x << np.uint64(k), x)
    return n


def common_prefixes(data: np.ndarray, words: np.ndarray, order: np.ndarray, last: np.ndarray, least: int = 0) -> np.ndarray:
    """For each place, how much its suffix shares with the one before it in the order; any smaller number where that is under `least`."""
    n = len(data)
    before = np.empty(n, dtype=np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    # Kasai: unless the bytes before the two differ, or one begins a document
    behind = np.append(np.uint8(END), data[:-1])
    own = (behind == END) | (behind != behind[before]) | (before < 0)
    i = np.flatnonzero(own)
    j = before[i]
    i, j = i[j >= 0], j[j >= 0]
    if least >= 8:  # only pairs that are alike there can share so much
        probe = least - 8
        fits = np.flatnonzero((last[i] - i >= least) & (words[np.minimum(i + probe, n - 1)] == words[np.minimum(j + probe, n - 1)]))
        i, j = i[fits], j[fits]
    most = np.minimum(last[i] - i, last[j] - j)
    shared = np.zeros(n, dtype=np.int64)
    at = 0
    while len(i):
        if at < 512:
            x = words[i + at] ^ words[j + at]
            differ = (x != 0) | (at + 8 >= most)
            shared[i[differ]] = np.minimum(at + np.where(x[differ] != 0, bytes_alike(x[differ]), 8), most[differ])
            i, j, most = i[~differ], j[~differ], most[~differ]
            at += 8
        else:  # few and long
            for a, b, m in zip(i.tolist(), j.tolist(), most.tolist(), strict=True):
                k = at
                while k < m:
                    unlike = np.flatnonzero(data[a + k : a + min(m, k + 65536)] != data[b + k : b + min(m, k + 65536)])
                    if len(unlike):
                        k += int(unlike[0])
                        break
                    k = min(m, k + 65536)
                shared[a] = k
            break
    rooted = np.arange(n) * own
    np.maximum.accumulate(rooted, out=rooted)
    out = shared[rooted]
    out += rooted
    out -= np.arange(n)
    return out


def repeats(data: np.ndarray, words: np.ndarray, last: np.ndarray, row: np.ndarray, number: np.ndarray, length: int, packed_bits: int = 21) -> np.ndarray:
    """Which starts of strings have an earlier one in the shard. row: the row of each place, in the order of ids; number: the rank of each row's id."""
    order = suffix_array(data, last, packed_bits)
    same = (common_prefixes(data, words, order, last, length) >= length)[order]
    same[0] = False
    gone = np.zeros(len(data), dtype=bool)
    member = same | np.append(same[1:], False)
    place, group = order[member], np.cumsum(~same)[member]
    if len(place):
        by = np.lexsort((place, group))
        place, group = place[by], group[by]
        opens = np.append(True, group[1:] != group[:-1])
        first = place[np.maximum.accumulate(np.where(opens, np.arange(len(place)), 0))]
        in_row = ~opens & np.append(False, row[place[1:]] == row[place[:-1]])
        gone[place] = in_row | (number[row[first]] < number[row[place]])
    return gone


def smallest(values: np.ndarray, wide: int) -> np.ndarray:
    """Where the smallest of each `wide` consecutive values is, the leftmost if equal."""
    out = []
    for start in range(0, len(values) - wide + 1, 1 << 15):
        low = (values[start : start + (1 << 15) + wide - 1] & ~np.uint64(0xFFFF)) | np.arange(min((1 << 15) + wide - 1, len(values) - start), dtype=np.uint64)
        have = 1
        while have < wide:
            step = min(have, wide - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        out.append(start + (low & np.uint64(0xFFFF)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def grams(words: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place."""
    n = len(words) - gram + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.full(n, gram, dtype=np.uint64)
    for k in [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mixed(h)


def runs_of(places: np.ndarray, *kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive places of the same kinds begin in the array, and how long they are."""
    if not len(places):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    opens = np.append(True, places[1:] != places[:-1] + 1)
    for kind in kinds:
        opens[1:] |= kind[1:] != kind[:-1]
    begins = np.flatnonzero(opens)
    return begins, np.diff(np.append(begins, len(places)))


def anchored(words: np.ndarray, starts: np.ndarray, row: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor, of those that begin at the ascending starts: (start, how many, hash of the anchor)."""
    h = grams(words, gram)
    at = smallest(h, length - gram + 1)[starts]
    begins, n = runs_of(starts, at, row[starts])
    return starts[begins], n, h[at[begins]]


def shard_rows(length: int, gram: int, shard: int, packed_bits: int):
    """(id, text_hash, start, n, anchor, leads) of the strings of each document: null anchor: they go; else they are to be looked up, and the first
    of the shard's records of an anchor leads."""
    names = ["id", "text_hash", "start", "n", "anchor", "leads"]

    def of(rows: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[0] is not None and r[0])
        data = np.frombuffer(b"".join(x for _, _, t in rows for x in (t, b"\xff")), dtype=np.uint8)
        size = np.array([len(t) + 1 for _, _, t in rows])
        ends = np.cumsum(size) - 1
        row = np.repeat(np.arange(len(rows)), size)
        last = ends[row]
        ids = np.array([r[0] or 0 for r in rows], dtype=np.int64)
        words = words_at(data)
        gone = repeats(data, words, last, row, np.cumsum(np.append(0, ids[1:] != ids[:-1])), length, packed_bits)
        places = np.arange(len(data))
        removed = places[gone]
        begins, n = runs_of(removed, row[removed])
        parts = [(removed[begins], n, None)]
        if rows[0][0] is not None:
            parts.append(anchored(words, places[~gone & (places + length <= last)], row, length, gram))
        start, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        which = row[start]
        anchors = pa.concat_arrays([pa.nulls(len(p[0]), pa.int64()) if p[2] is None else pa.array(p[2].view(np.int64)) for p in parts])
        leads = np.zeros(len(start), dtype=np.int32)
        if len(parts) > 1:
            leads[len(begins) + np.unique(parts[1][2], return_index=True)[1]] = 1
        id_column = pa.array(ids[which], pa.int64(), mask=np.full(len(which), rows[0][0] is None))
        hashes = np.array([r[1] for r in rows], dtype=np.int32)[which]
        return pa.RecordBatch.from_arrays([id_column, pa.array(hashes), pa.array(start - (ends - size + 1)[which]), pa.array(n.astype(np.int32)), anchors, pa.array(leads)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, int, bytes]] = []
        size = 0
        for batch in sliced(batches, "text"):
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binaries(batch.column(2)), strict=True):
                if len(text) < length:
                    continue
                if i is None:
                    yield of([(i, h, text)])
                    continue
                if held and size + len(text) + 1 > shard:
                    yield of(held)
                    held, size = [], 0
                held.append((i, h, text))
                size += len(text) + 1
        if held:
            yield of(held)

    return run


def with_bytes(length: int):
    """Records of a document's text, each with the bytes of its strings."""
    names = ["id", "text_hash", "start", "n", "anchor", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1_000_000):
            lists = batch.column(3)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            texts = binaries(batch.column(2))
            which = np.repeat(np.arange(len(size)), size)
            content = [texts[w][s : s + k + length - 1] for w, s, k in zip(which.tolist(), start.tolist(), n.tolist(), strict=True)]
            at = pa.array(which)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(start), pa.array(n), flat.field("anchor"), pa.array(content, pa.binary())], names)

    return run


def merge(length: int):
    """The records of some anchors: (id, text_hash, start, n, content) of the strings that go, and with content those of a hot anchor that stay."""
    names = ["id", "text_hash", "start", "n", "content"]
    rolling = Rolling()

    def run(records: pa.Table) -> pa.Table:
        ids, starts, n = (records.column(c).to_numpy() for c in ("id", "start", "n"))
        by = np.lexsort((starts, ids))
        ids, starts, n = ids[by], starts[by], n[by].astype(np.int64)
        anchors, hot = records.column("anchor").to_numpy()[by].view(np.uint64), records.column("hot").to_numpy()[by]
        content = records.column("content").combine_chunks().take(pa.array(by)).to_pylist()
        # a record with the bytes of an earlier one goes as a whole; only the others are looked through
        seen: dict[bytes, int] = {}
        whole = np.array([ids[seen.setdefault(c, k)] < ids[k] for k, c in enumerate(content)], dtype=bool)
        out = [(by[whole], starts[whole], n[whole], pa.nulls(int(whole.sum()), pa.binary()))]
        content = [c for c, w in zip(content, whole.tolist(), strict=True) if not w]
        by, ids, starts, n, anchors, hot = (x[~whole] for x in (by, ids, starts, n, anchors, hot))
        begins = np.concatenate([[0], np.cumsum(n + length - 1)])[:-1]
        data = np.frombuffer(b"".join(content), dtype=np.uint8)
        ends = np.cumsum(n)
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(row)) - (ends - n)[row]
        key = mixed(rolling.runs(BYTE_HASHES[data], length)[begins[row] + within] ^ anchors[row])
        known = np.unique(key)  # the strings of all shards in one order
        found = np.searchsorted(known, key)
        owner = np.empty(len(known), dtype=np.int64)
        owner[found[::-1]] = row[::-1]  # the last to write is the first record: the smallest id
        gone = ids[owner[found]] < ids[row]
        for chosen, texts in ((gone, False), (~gone & hot[row], True)):
            at = np.flatnonzero(chosen)
            first, size = runs_of(at, row[at])
            r, w = row[at[first]], within[at[first]]
            stays = [data[b : b + k + length - 1].tobytes() for b, k in zip((begins[r] + w).tolist(), size.tolist(), strict=True)] if texts else None
            out.append((by[r], starts[r] + w, size, pa.nulls(len(r), pa.binary()) if stays is None else pa.array(stays, pa.binary())))
        r, start, size = (np.concatenate(c) for c in zip(*((a, b, c) for a, b, c, _ in out), strict=True))
        at = pa.array(r)
        return pa.Table.from_arrays([records.column("id").take(at), records.column("text_hash").take(at), pa.array(start), pa.array(size.astype(np.int32)), pa.concat_arrays([x[3] for x in out])], names)

    return run


def anchored_again(length: int, gram: int):
    """Records of strings by anchors of another length."""
    names = ["id", "text_hash", "start", "n", "anchor", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for k, (start, content) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                data = np.frombuffer(content, dtype=np.uint8)
                places = np.arange(len(data) - length + 1)
                s, n, h = anchored(words_at(data), places, np.zeros(len(data), dtype=np.int8), length, gram)
                parts += [(k, start + a, m, x, content[a : a + m + length - 1]) for a, m, x in zip(s.tolist(), n.tolist(), h.view(np.int64).tolist(), strict=True)]
            if parts:
                k, start, n, anchor, content = zip(*parts, strict=True)
                at = pa.array(k)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(anchor, pa.int64()), pa.array(content, pa.binary())], names)

    return run


RECORD = "id long, text_hash int, start long, n int"


def merged(records: DataFrame, length: int, gram: int, most: int, bucket_bytes: int) -> list[DataFrame]:
    """(id, text_hash, start, n) tables of strings that an earlier document in another record has."""
    out = []
    step = gram
    while True:
        counts = records.groupBy("anchor").agg(F.count("*").alias("records"), F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b")
        counts = saved(counts.select("anchor", "records", (F.col("records") > most).alias("hot")), "counts")
        parts = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.ceil(F.col("records") / most))).otherwise(0)
        dealt = records.join(counts, "anchor").withColumn("part", parts)
        size = records.agg(F.sum(F.length("content"))).first()[0] or 0
        buckets = ceil_div(size, bucket_bytes) or 1
        dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("anchor", "part"), F.lit(buckets)))
        done = saved(dealt.groupBy("bucket").applyInArrow(merge(length), f"{RECORD}, content binary"), "merged")
        out.append(done.filter("content IS NULL").drop("content"))
        if counts.filter("hot").isEmpty():
            return out
        step = min(length, step + (length - gram + 1) // 2)
        records = saved(done.filter("content IS NOT NULL").mapInArrow(anchored_again(length, step), f"{RECORD}, anchor long, content binary"), "records")
        if step == length:  # an anchor is the string itself: its first document is a minimum, gathered in parts
            first = records.groupBy("anchor").agg(F.min("id").alias("first"))
            out.append(records.join(first, "anchor").filter("id > first").select("id", "text_hash", "start", "n"))
            return out


def remove(length: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out = []
            for text, runs in zip(binaries(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                kept, spans = text, 0
                if runs:
                    cover = np.zeros(len(text) + 1, dtype=np.int64)
                    for r in runs:
                        cover[r["start"]] += 1
                        cover[r["start"] + r["n"] + length - 1] -= 1
                    gone = np.cumsum(cover)[:-1] > 0
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                out.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names)

    return run


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, most: int = MOST, bucket_bytes: int = BUCKET_BYTES, packed_bits: int = 21
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and kept, the bytes that are left."""
    if not 8 <= gram <= length:
        raise ValueError("an anchor has eight bytes or more, and no more than a string")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.hash("text"))
    found = saved(docs.select("id", "text_hash", "text").mapInArrow(shard_rows(length, gram, shard, packed_bits), f"{RECORD}, anchor long, leads int"), "strings")
    gone = saved(found.filter("anchor IS NULL").select("id", "text_hash", "start", "n"), "gone")
    common = found.filter("leads = 1").groupBy("anchor").agg(F.count("*").alias("shards")).filter("shards > 1").select("anchor")
    places = saved(found.filter("anchor IS NOT NULL").drop("leads").join(common, "anchor"), "places")
    discard(found)
    lists = places.groupBy("id", "text_hash").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("strings"))
    records = docs.filter("id IS NOT NULL").join(lists, ["id", "text_hash"]).select("id", "text_hash", "text", "strings")
    records = saved(records.mapInArrow(with_bytes(length), f"{RECORD}, anchor long, content binary"), "records")
    discard(places)
    tables = [gone, *merged(records, length, gram, most, bucket_bytes)]
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    runs = every.groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("runs")).withColumnsRenamed({"id": "r_id", "text_hash": "r_hash"})
    whole = docs.join(runs, docs["id"].eqNullSafe(F.col("r_id")) & (docs["text_hash"] == F.col("r_hash")), "left").select("id", "text", "runs")
    return whole.mapInArrow(remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
