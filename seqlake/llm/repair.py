"""Token ids in Re-Pair compressed shard files (Larsson and Moffat, 2000).

A shard holds the documents of one range of doc_id, in order. Frequent pairs of neighbouring
symbols within a document are replaced by new symbols, round after round, until no pair
occurs LEAST times or the rules that fit 16 bits beside the ids are used up; each round takes
the most frequent pairs, at most half of the room that is left, and replaces their
occurrences from left to right. The file keeps the rules, each rule's expansion length, and
for each document its first symbol and its number of ids, so any document, or any id in it,
is found without expanding what comes before.

Layout, little endian: ``RPR1``; u32 number of terminals; u32 rules; u32 documents; u64
symbols; u8 bytes of a symbol (2 or 4); rules (u32 left, u32 right); expansion lengths
(u32); doc_ids (i64); first symbols (u64, documents + 1); ids (u64, by document); symbols.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from seqlake.llm.shared import new_path, open_fs, settled, ship, table

MAGIC, HEAD = b"RPR1", "<4sIIIQB"
END = 0
#: Symbols of two bytes; rules that a shard may have where the ids alone need more; and occurrences that a pair needs to pay for its rule.
NARROW, MOST_RULES, LEAST = 1 << 16, 1 << 15, 12
#: Pieces whose ids a worker keeps and their bytes, and ids that one file holds before the next begins.
KEPT, KEPT_BYTES, FILE_IDS = 250_000, 32 << 20, 1 << 20

#: Pieces that are encoded together where they are met first, bytes of text that are encoded at a time, and bytes of text whose ids are made at a time when partitions are dealt.
TOGETHER, BATCH_BYTES, PARTITION_BYTES = 256, 2 << 20, 64 << 20
#: Rules that the last round may take at once.
LAST = 1024
#: Slots that pairs are counted in, as a power of two, and what deals them.
SLOT_BITS = 18
MIX = np.uint64(0x9E3779B97F4A7C15)
#: What may end a piece after a letter or digit, and is then a piece of its own: no letter, digit, space or apostrophe.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes that are letters or digits of ASCII.
WORD = np.array([chr(i).isalnum() and i < 0x80 for i in range(256)])
#: All that Python or the library takes for white space.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_CACHE: dict = {}


def _gather(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs flat[first : first + n] one after another."""
    stop = np.cumsum(n)
    return flat[np.repeat(first - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]


class Encoder:
    """Token ids of whole texts with the tokenizers library; runs of text between spaces are encoded once and kept.

    The pre-tokeniser never joins a space that follows a non-space to what comes before it, and a
    single line break between non-spaces stands alone, so ids of the pieces cut there are the ids of
    the text. A text with white space beside white space, or with a special token, is encoded whole.
    A piece is also cut between a letter or digit and the marks that end it, where the pre-tokeniser
    always cuts. Pieces are met TOGETHER in one call where each begins with a space and ends without one: their text is again
    cut between them, and the bytes of the ids say where. Texts are cut and their pieces numbered in Arrow, a batch at a time;
    only a batch's distinct pieces come to Python.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.terminals = self.t.get_vocab_size(with_added_tokens=True)
        self.special = [a.content for a in self.t.get_added_tokens_decoder().values()]
        #: Bytes of each id: a byte-level vocabulary has a character for each.
        self.bytes = np.zeros(self.terminals, np.int64)
        for token, i in self.t.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = len(token)
        self.clear()

    def clear(self) -> None:
        import pyarrow as pa

        self.known = pa.array([], pa.large_string())
        self.flat, self.used, self.ends, self.met = np.empty(1 << 20, np.uint32), 0, np.zeros(1, np.int64), np.zeros(0, np.int32)

    def forget(self) -> None:
        """Leaves the pieces met in several batches, if those are not too many."""
        stay = np.flatnonzero(self.met > 1)
        known, counts = self.known.take(stay), np.diff(self.ends)[stay]
        if len(stay) > KEPT // 2 or known.nbytes > KEPT_BYTES // 2:
            return self.clear()
        ids = _gather(self.flat, self.ends[stay], counts)
        self.clear()
        self._add(known, ids, counts)
        self.met[:] = 1

    def _pieces(self, new) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of pieces one after another, and their number by piece."""
        import pyarrow.compute as pc

        joint = pc.and_not(pc.starts_with(new, " "), pc.match_substring_regex(new, WHITE + r"\z"))
        single, together = new.filter(pc.invert(joint)).to_pylist(), new.filter(joint)
        joint = joint.to_numpy(zero_copy_only=False)
        edge = np.concatenate(([0], np.cumsum(pc.binary_length(together).to_numpy())))
        got = [e.ids for e in self.t.encode_batch_fast(single, add_special_tokens=False)]
        alone, own = np.array([x for ids in got for x in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)
        cut = edge[np.append(np.arange(0, len(together), TOGETHER), len(together))].tolist()
        data, at = together.buffers()[2], int(np.frombuffer(together.buffers()[1], np.int64)[together.offset]) if len(together) else 0
        runs = [data[at + lo : at + hi].to_pybytes().decode() for lo, hi in zip(cut, cut[1:])]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.t.encode_batch_fast(runs, add_special_tokens=False))])
        end, at = edge[1:], np.cumsum(self.bytes[ids])
        last = np.searchsorted(at, end)
        if len(end) and (last[-1] >= len(at) or (at[last] != end).any()):
            raise ValueError("ids that do not end where their pieces do")
        stop = last + 1
        counts, start = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        counts[~joint], counts[joint] = own, np.diff(np.concatenate(([0], stop)))
        # Both kinds in the order of the pieces.
        start[~joint], start[joint] = np.cumsum(own) - own, len(alone) + np.concatenate(([0], stop[:-1])) if len(stop) else 0
        return _gather(np.concatenate((alone, ids)), start, counts), counts

    def _add(self, new, ids: np.ndarray, counts: np.ndarray) -> None:
        import pyarrow as pa

        self.known = pa.concat_arrays([self.known, new])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.ends = np.concatenate((self.ends, self.used + np.cumsum(counts)))
        self.used += len(ids)
        self.met = np.concatenate((self.met, np.zeros(len(counts), np.int32)))

    def _runs(self, chunks) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of distinct chunks one after another, and their number by chunk: those of its stem and of the marks after it."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        at = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
        stem = pc.binary_length(pc.utf8_rtrim(chunks, TAIL)).to_numpy()
        end = at[:-1] + stem
        data = np.frombuffer(chunks.buffers()[2] or b"\0", np.uint8)
        c, before = data[np.maximum(end - 1, 0)], data[np.maximum(end - 2, 0)]
        # A letter or digit of ASCII, or a letter of U+00C0 to U+023F.
        letter = WORD[c] | ((c >= 0x80) & (c < 0xC0) & (before >= 0xC3) & (before <= 0xC8) & ~((before == 0xC3) & ((c == 0x97) | (c == 0xB7))))
        edge = np.empty(2 * len(chunks) + 1, np.int64)
        edge[::2], edge[1::2] = at, np.where((stem > 0) & letter, end, at[1:])
        halves = pa.LargeStringArray.from_buffers(2 * len(chunks), pa.py_buffer(edge), chunks.buffers()[2]).dictionary_encode()
        if len(self.known) > KEPT or self.known.nbytes > KEPT_BYTES:
            self.forget()
        distinct = halves.dictionary
        k = pc.index_in(distinct, value_set=self.known)
        new = distinct.filter(k.is_null())
        k = k.fill_null(-1).to_numpy().astype(np.int64)
        k[k < 0] = len(self.known) + np.arange(len(new))
        if len(new):
            self._add(new, *self._pieces(new))
        self.met[k] += 1
        first, n, of = self.ends[k], self.ends[k + 1] - self.ends[k], halves.indices.to_numpy()
        n = n[of]
        return _gather(self.flat, first[of], n), n[::2] + n[1::2]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, a list or an Arrow column, one after another, and their number by text; a null is an empty text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, WHITE + r"{2}|\x00")
        for a in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        whole = {int(i): texts[int(i)].as_py() for i in odd}
        if whole:
            keep = np.ones(len(texts), bool)
            keep[odd] = False
            texts = pc.if_else(pa.array(keep), texts, pa.scalar(None, pa.large_string()))
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")
        sizes = pc.fill_null(cut.value_lengths(), 0).to_numpy(zero_copy_only=False)
        chunks = cut.flatten().dictionary_encode()
        flat, n = self._runs(chunks.dictionary)
        of = chunks.indices.to_numpy()
        first, n = (np.cumsum(n) - n)[of], n[of]
        ids = _gather(flat, first, n)
        edge = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(sizes)))]
        counts = np.diff(edge)
        if whole:
            got = {i: np.array(e.ids, np.uint32) for i, e in zip(whole, self.t.encode_batch_fast(list(whole.values()), add_special_tokens=False))}
            ids = np.concatenate([got[i] if i in got else ids[edge[i] : edge[i + 1]] for i in range(len(texts))])
            counts = np.array([len(got[i]) if i in got else counts[i] for i in range(len(texts))])
        return ids, counts


def room(terminals: int) -> int:
    """Rules that a shard may have: with the terminals they fit two bytes, if that leaves any."""
    return NARROW - terminals if terminals < NARROW else MOST_RULES


def compress(ids: np.ndarray, counts: np.ndarray, terminals: int, most: int | None = None, least: int = LEAST):
    """(symbols, symbols by document, rules) of documents' ids; no pair reaches over a document's end.

    The rounds end when no pair occurs ``least`` times or there are ``most`` rules. A round that takes
    every pair that occurs ``least`` times leaves none of their occurrences but under new symbols, so
    the next one looks at the pairs with a new symbol only.
    """
    most = room(terminals) if most is None else most
    # Two symbols of two bytes are a number of four.
    kind, bits, mult = (np.uint32, 16, np.uint32(MIX >> np.uint64(32))) if terminals + most <= NARROW else (np.uint64, 32, MIX)
    slots = lambda p: ((p * mult) >> kind(2 * bits - SLOT_BITS)).astype(np.int64)
    sym = ids.astype(kind)
    last = np.zeros(len(sym), bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    rules: list = []
    of_slot = np.full(1 << SLOT_BITS, -1, np.int32)  # the rule of a slot's pair in this round
    held = np.cumsum(counts)  # end of each document in symbols
    made, since = 0, None  # rules, and those before the last round if that took all
    while made < most and len(sym) > 1:
        inside = ~last[:-1]
        if since is not None:
            new = sym >= terminals + since
            inside &= new[:-1] | new[1:]
        here = np.flatnonzero(inside)
        pair = (sym[here] << kind(bits)) | sym[here + 1]
        slot = slots(pair)
        often = np.bincount(slot, minlength=1 << SLOT_BITS)
        left = most - made
        take = left if left <= LAST else max(LAST, left // 2)  # the last rules are not worth a round each
        # Slots that hold twice as many pairs as are taken, the fullest first; all that can hold one where those have none.
        full = often[often >= least]
        many = int(np.partition(full, -2 * take)[-2 * take]) if len(full) > 2 * take else least
        for bound in sorted({many, least}, reverse=True):
            hot = np.flatnonzero((often >= bound)[slot])
            p, n = np.unique(pair[hot], return_counts=True)
            p, n = p[n >= least], n[n >= least]
            if len(p):
                break
        else:
            break
        every = len(p) if bound == least else -1
        p = p[np.sort(np.argsort(-n, kind="stable")[:take])]
        of_slot[slots(p)] = np.arange(len(p))
        p = p[of_slot[slots(p)] == np.arange(len(p))]  # one pair of a slot a round; another's turn comes
        own = slots(p)
        of_slot[own] = np.arange(len(p))
        where = of_slot[slot[hot]]
        of_slot[own] = -1
        good = np.flatnonzero((where >= 0) & (p[where] == pair[hot]))
        at, rule = here[hot[good]], where[good]
        run = np.concatenate(([True], np.diff(at) != 1))  # in a run of overlapping occurrences every other one is taken
        first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - first) % 2 == 0
        at, rule = at[take], rule[take]
        sym[at] = (terminals + made + rule).astype(kind)
        last[at] = last[at + 1]
        held = held - np.searchsorted(at + 1, held)
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        stay = np.flatnonzero(stay)
        sym, last = sym[stay], last[stay]
        rules.append(np.stack((p >> kind(bits), p & kind((1 << bits) - 1)), 1).astype(np.uint32))
        since = made if len(p) == every else None
        made += len(p)
    rule = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return sym.astype(np.uint32), np.diff(np.concatenate(([0], held))), rule


def lengths(rule: np.ndarray, terminals: int) -> np.ndarray:
    """Number of ids below each rule; a rule uses earlier ones only."""
    out = np.ones(terminals + len(rule), np.int64)
    todo = np.arange(len(rule))
    out[terminals:] = 0
    while len(todo):
        a, b = out[rule[todo, 0]], out[rule[todo, 1]]
        ok = (a > 0) & (b > 0)
        out[terminals + todo[ok]] = a[ok] + b[ok]
        todo = todo[~ok]
    return out[terminals:]


def expand(sym: np.ndarray, rule: np.ndarray, terminals: int) -> np.ndarray:
    """The ids of symbols."""
    n = lengths(rule, terminals)
    start = np.cumsum(n) - n
    flat = np.arange(terminals, terminals + len(rule)).astype(np.uint32)
    while len(at := np.flatnonzero(flat >= terminals)):  # all rules at once, as often as rules lie one in another
        size = np.ones(len(flat), np.int64)
        size[at] = 2
        to = np.cumsum(size) - size
        pairs = rule[flat[at].astype(np.int64) - terminals]
        longer = np.empty(int(size.sum()), np.uint32)
        longer[to] = flat
        longer[to[at]], longer[to[at] + 1] = pairs[:, 0], pairs[:, 1]
        flat = longer
    is_rule = sym >= terminals
    which = np.where(is_rule, sym.astype(np.int64) - terminals, 0)
    size = np.where(is_rule, n[which] if len(n) else 1, 1)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint32)
    out[(end - size)[~is_rule]] = sym[~is_rule]
    r = np.flatnonzero(is_rule)
    if len(r):
        k = size[r]
        off = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        out[np.repeat((end - size)[r], k) + off] = flat[np.repeat(start[which[r]], k) + off]
    return out


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, terminals: int) -> bytes:
    if len(ids) and int(ids.max()) >= terminals:
        raise ValueError(f"an id of {int(ids.max())}; the tokenizer has {terminals}")
    sym, per, rule = compress(ids, counts, terminals)
    width = 2 if terminals + len(rule) <= NARROW else 4
    first = np.concatenate(([0], np.cumsum(per))).astype("<u8")
    return b"".join((
        struct.pack(HEAD, MAGIC, terminals, len(rule), len(doc_ids), len(sym), width), rule.astype("<u4").tobytes(), lengths(rule, terminals).astype("<u4").tobytes(),
        np.asarray(doc_ids, "<i8").tobytes(), first.tobytes(), np.asarray(counts, "<u8").tobytes(), sym.astype("<u2" if width == 2 else "<u4").tobytes(),
    ))


class Shard:
    """An open shard file: the index is read once, documents' symbols on demand."""

    def __init__(self, f):
        self.f = f
        magic, self.terminals, n_rules, self.docs, self.symbols, self.width = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
        if magic != MAGIC:
            raise ValueError("not a Re-Pair shard")
        read = lambda n, kind: np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind)
        self.rule = read(2 * n_rules, "<u4").reshape(-1, 2)
        self.length = read(n_rules, "<u4").astype(np.int64)
        self.doc_ids, self.first, self.counts = read(self.docs, "<i8"), read(self.docs + 1, "<u8").astype(np.int64), read(self.docs, "<u8").astype(np.int64)
        self.at = f.tell()

    def part(self, lo: int, hi: int) -> np.ndarray:
        """The symbols of documents lo to hi - 1."""
        self.f.seek(self.at + int(self.first[lo]) * self.width)
        return np.frombuffer(self.f.read(int(self.first[hi] - self.first[lo]) * self.width), "<u2" if self.width == 2 else "<u4")

    def document(self, i: int) -> np.ndarray:
        return expand(self.part(i, i + 1), self.rule, self.terminals)

    def token(self, i: int, k: int) -> int:
        """The k-th id of document i: expansion lengths lead to its symbol and down the rules."""
        sym = self.part(i, i + 1).astype(np.int64)
        end = np.cumsum(np.where(sym < self.terminals, 1, self.length[np.maximum(sym - self.terminals, 0)] if len(self.length) else 1))
        j = int(np.searchsorted(end, k, side="right"))
        k -= int(end[j - 1]) if j else 0
        s = int(sym[j])
        while s >= self.terminals:
            left, right = (int(x) for x in self.rule[s - self.terminals])
            n = 1 if left < self.terminals else int(self.length[left - self.terminals])
            s, k = (left, k) if k < n else (right, k - n)
        return s


def _write(tokenizer: str, folder: str):
    def run(frames):
        """Sorted (doc_id, text) to files; a row for each: its path, first id, documents and ids. A task that runs again writes other files."""
        import pyarrow as pa
        from pyspark import TaskContext

        from seqlake.llm.words import batches

        if tokenizer not in _CACHE:
            _CACHE.clear()  # one vocabulary at a time is kept
            _CACHE[tokenizer] = Encoder(tokenizer)
        enc, part = _CACHE[tokenizer], TaskContext.get().partitionId()
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        held: list = []
        rows: list = []
        total = 0

        def flush():
            pa.default_memory_pool().release_unused()  # what encoding has freed, before what packing takes
            doc, n, ids = (np.concatenate([h[k] for h in held]) for k in range(3))
            name = f"part-{part:06d}-{len(rows):04d}-{uuid.uuid4().hex}.rpr"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(pack(doc, n, ids, enc.terminals))
            rows.append((f"{folder}/{name}", part, len(rows), len(doc), int(n.sum())))
            held.clear()

        for b in frames:
            text = b.column(1)
            for lo, hi in batches(text, BATCH_BYTES):
                ids, n = enc.encode(text.slice(lo, hi - lo))
                ids = np.insert(ids, np.cumsum(n), END)
                doc, n = b.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False), n + 1
                ends = np.cumsum(n)
                at = 0
                while at < len(n):  # a file ends with the document that fills it
                    begin = int(ends[at - 1]) if at else 0
                    to = min(int(np.searchsorted(ends, begin + FILE_IDS - total)) + 1, len(n))
                    held.append((doc[at:to], n[at:to], ids[begin : ends[to - 1]]))
                    total, at = total + int(ends[to - 1]) - begin, to
                    if total >= FILE_IDS:
                        flush()
                        total = 0
        if held:
            flush()
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "part", "file", "docs", "ids"), map(list, zip(*rows)))), schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("file", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return run


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; the manifest: path, part, file, docs, ids, start.

    A null or empty text is the end id alone. Equal doc_ids keep their rows, in order of their
    texts; a null doc_id is left out, since it has no place in the order. No rows: no files.
    ``start`` is the number of ids in all files before; the manifest has a row for a file, and
    is a table. ``tokenizer`` is a path that every executor has. Partitions are as many as the
    input's size asks for.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("doc_id is not null")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the planner's estimate, from the files' sizes
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // PARTITION_BYTES, 1 << 17), 1)
    placed = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    files = table(placed.mapInArrow(settled(_write(tokenizer, new_path(spark, "tokens"))), "path string, part int, file int, docs long, ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table(files.withColumn("_inside", inside).join(parts, "part").select("path", "part", "file", "docs", "ids", (F.col("_before") + F.col("_inside")).alias("start")), "starts")


def _read(frames):
    import pyarrow as pa

    for b in frames:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            fs, name = open_fs(path)
            with fs.open_input_file(name) as f:
                s = Shard(f)
                lo = 0
                while lo < s.docs:  # some million symbols at a time
                    hi = max(lo + 1, int(np.searchsorted(s.first, s.first[lo] + (1 << 20), side="right")) - 1)
                    ids = expand(s.part(lo, hi), s.rule, s.terminals).astype("<u4")
                    n = s.counts[lo:hi]
                    ends = np.cumsum(n)
                    crc = [zlib.crc32(ids[e - k : e]) for e, k in zip(ends.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[lo:hi]), pa.array(start + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])
                    lo = hi


def decode(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that a manifest names; several files a task where there are many."""
    spark = manifest.sparkSession
    ship(spark)
    files = manifest.count()
    tasks = max(1, min(files, int(spark.conf.get("spark.sql.shuffle.partitions"))), files // 16)
    rows = manifest.select("path", "start").repartition(tasks)
    return rows.mapInArrow(settled(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")
