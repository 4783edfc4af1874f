"""Token counts by prefix dynamic programming.

For byte-level BPE the encoding of a prefix ends in exactly one token t such that the encoding of what stands
before t ends in a token that forms a valid pair with t (two tokens are a valid pair if the model encodes their
joined bytes as just these two). So one pass over a piece gives, for every prefix, its last token and

    count[i] = count[i - len(t)] + 1

The count at every prefix answers how many tokens a cut text has and where a budget ends, with no further encoding.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_dictionary, chunk_starts, freeing, latin_letters, text_blocks

#: Fixed values of the byte-level alphabet: printable bytes stand for themselves, others follow from U+0100.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in set(_PLAIN)]
BYTE_CHARS = str.maketrans({chr(b): chr(256 + k) for k, b in enumerate(_OTHER)})

#: White space as the pre-tokenizer sees it (first and last code point of each range).
_SPACE_RANGES = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
_S = "".join(f"{chr(92)}U{a:08x}-{chr(92)}U{b:08x}" for a, b in _SPACE_RANGES)

#: The pattern of the byte-level pre-tokenizer.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
SPACES = rf"[{_S}]+"

#: Bytes of a worker's table of chunks, and entries of its other tables, beyond which they start anew: memory bounds
#: that no result depends on. An entry counts for what its key and numbers take in Python besides its own bytes.
TABLE_BYTES, ENTRY_BYTES = 48 << 20, 200
MOST_PREFIXES = 150_000
#: Bytes of text counted at once.
BLOCK = 2 << 20
#: Pre-tokens of at most LONGEST bytes are counted side by side, some PIECE_BYTES at once.
LONGEST, PIECE_BYTES = 64, 1 << 18


class KeyTable:
    """Integers by integer keys from 0 on, looked up many at a time; it must not be filled to the last slot."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.held = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, -1 for those that are not held."""
        at = self._slots(keys)
        there = self.keys[at]
        same = there == keys
        out = np.where(same, self.values[at], np.int32(-1))
        left = np.flatnonzero(~same & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            there = self.keys[at[left]]
            same = there == keys[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not held yet."""
        at, left = self._slots(keys), np.arange(len(keys))
        self.held += len(keys)
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            placed = self.keys[at[left]] == keys[left]
            self.values[at[left[placed]]] = values[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & self.mask


class PrefixCounter:
    """Exact token counts at every code point prefix, for a tokenizers file of kind byte-level BPE."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("prefix counts need a byte-level BPE without normalizer")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take white space or words with them are not supported")
        self.vocab = frozenset(k for k in spec["model"]["vocab"] if k not in self.special)
        lengths: dict[str, set[int]] = {}
        for k in self.vocab:
            if len(k) > 1:
                lengths.setdefault(k[-2:], set()).add(len(k))
        self.lengths = {k: sorted(v) for k, v in lengths.items()}
        self.pieces = regex.compile(PIECES)
        self.spaces = regex.compile(SPACES)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pairs: dict[tuple, bool] = {}
        self.alone: dict[str, bool] = {}
        self.prefixes: dict[str, tuple[int, int]] = {}
        self._trie()

    def _trie(self) -> None:
        """Nodes of the prefixes of all tokens: 0 is empty, 1 to 256 are the bytes; `steps` leads from node and byte to node."""
        byte = {chr(b).translate(BYTE_CHARS): b for b in range(256)}
        self.names = ["", *byte]
        node = {name: k for k, name in enumerate(self.names)}
        keys = []
        for t in self.vocab:
            if len(t) > 1 and byte.keys() >= set(t):
                at = len(t)
                while t[:at] not in node:
                    at -= 1
                for i in range(at + 1, len(t) + 1):
                    keys.append(node[t[: i - 1]] << 8 | byte[t[i - 1]])
                    node[t[:i]] = len(self.names)
                    self.names.append(t[:i])
        self.steps = KeyTable((4 * len(keys) + 4).bit_length())
        self.steps.put(np.array(keys, np.int64), np.arange(257, len(self.names), dtype=np.int32))
        self.token = np.fromiter((len(name) > 1 and name in self.vocab for name in self.names), bool)
        self.fits = KeyTable((2 * MOST_PREFIXES).bit_length())

    def _fits(self, before: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Whether token `node` may follow token `before`, or may come first where that is 0."""
        key = before.astype(np.int64) * len(self.names) + node
        fits = self.fits.get(key)
        new = np.flatnonzero(fits < 0)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            made = np.zeros(len(keys), np.int32)
            for k, (a, b) in enumerate(zip((keys // len(self.names)).tolist(), (keys % len(self.names)).tolist(), strict=True)):
                a, b = self.names[a], self.names[b]
                made[k] = [t.value for t in self.model.tokenize(a + b)] == ([a, b] if a else [b])
            fits[new] = made[back]
            if self.fits.held + len(keys) > MOST_PREFIXES:
                self.fits.clear()
            self.fits.put(keys[:MOST_PREFIXES], made)
        return fits > 0

    def pieces_at_once(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Token counts of the prefixes of 1, 2, ... bytes of each pre-token; these begin at `first` (one more at the end)."""
        size = np.diff(first)
        begin = np.repeat(first[:-1], size)
        end = begin + np.repeat(size, size)
        place = (np.arange(len(data)) - begin).astype(np.uint8)
        # all tokens of two and more bytes that stand anywhere: their first and last bytes, and nodes
        at, node, last = np.arange(len(data)), data.astype(np.int64) + 1, data.astype(np.int32) + 1
        found = []
        for n in range(1, int(size.max())):
            more = at + n < end[at]
            at, node = at[more], node[more].astype(np.int64)
            node = self.steps.get(node << 8 | data[at + n])
            more = node >= 0
            at, node = at[more], node[more]
            if not len(at):
                break
            token = self.token[node]
            found.append((at[token], at[token] + n, node[token]))
        counts = place.astype(np.int32) + 1
        if not found:
            return counts
        starts, ends, nodes = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place[ends], kind="stable")
        starts, ends, nodes = starts[order], ends[order], nodes[order]
        token_cuts = np.searchsorted(place[ends], np.arange(int(size.max()) + 1))
        points = np.argsort(place, kind="stable")
        point_cuts = np.searchsorted(place[points], np.arange(int(size.max()) + 1))
        for k in range(1, int(size.max())):
            p = points[point_cuts[k] : point_cuts[k + 1]]
            counts[p] = counts[p - 1] + 1
            here = slice(token_cuts[k], token_cuts[k + 1])
            s, e, t = starts[here], ends[here], nodes[here]
            inner = place[s] > 0
            ok = self._fits(np.where(inner, last[s - 1], 0), t)
            s, e, t, inner = s[ok], e[ok], t[ok], inner[ok]
            last[e] = t
            counts[e] = np.where(inner, counts[s - 1], 0) + 1
        return counts

    def _pair(self, a: str, b: str) -> bool:
        k = (a, b)
        ok = self.pairs.get(k)
        if ok is None:
            if len(self.pairs) > MOST_PREFIXES:
                self.pairs.clear()
            ok = self.pairs[k] = [t.value for t in self.model.tokenize(a + b)] == [a, b]
        return ok

    def _alone(self, a: str) -> bool:
        ok = self.alone.get(a)
        if ok is None:
            ok = self.alone[a] = len(self.model.tokenize(a)) == 1
        return ok

    def piece(self, p: str):
        """Token counts of the prefixes of 1, 2, ... bytes of a pre-token in the byte alphabet."""
        n = len(p)
        if n > 64:
            sizes, counts = [], []
            for i in range(1, n + 1):
                size = self._last(p, i, sizes)
                sizes.append(size)
                counts.append(1 + (counts[i - size - 1] if i > size else 0))
            return counts
        known = self.prefixes
        at, (sizes, counts) = n, known.get(p, (None, None))
        while sizes is None:
            at -= 1
            sizes, counts = known.get(p[:at], (None, None)) if at else (b"", b"")
        if at < n and len(known) > MOST_PREFIXES:
            known.clear()
        for i in range(at + 1, n + 1):
            size = self._last(p, i, sizes)
            sizes += bytes((size,))
            counts += bytes((1 + (counts[i - size - 1] if i > size else 0),))
            known[p[:i]] = (sizes, counts)
        return counts

    def _last(self, p: str, i: int, sizes) -> int:
        """Size of the last token of p[:i], given the sizes for the shorter prefixes."""
        if i == 1:
            return 1
        grown = sizes[i - 2] + 1
        for n in (grown, *self.lengths.get(p[i - 2 : i], ())):
            if n > i:
                if n == grown:
                    continue
                break
            if (t := p[i - n : i]) in self.vocab and (self._alone(t) if n == i else self._pair(p[i - n - sizes[i - n - 1] : i - n], t)):
                return n
        return 1

    def _points(self, raw: str):
        """Counts at the ends of the code points of one pre-token."""
        data = raw.encode()
        counts = self.piece(data.decode("latin-1").translate(BYTE_CHARS))
        if len(raw) == len(data):
            return counts
        return [c for c, b in zip(counts, [*data[1:], 0], strict=True) if b & 0xC0 != 0x80]

    def chunk(self, chunk: bytes):
        """Counts at the code point prefixes of a chunk; most are one pre-token and need no pattern."""
        if chunk.isalpha():
            return self.piece(chunk.decode("latin-1"))
        if chunk[0] == 32 and (body := chunk[1:]) and body.isalpha():
            return self.piece("\u0120" + body.decode("latin-1"))
        raw = chunk.decode()
        if raw.isalpha() or raw[0] == " " and raw[1:].isalpha():
            return self._points(raw)
        return self.plain(raw)

    def chunks(self, chunks: list[bytes]):
        """What `chunk` gives for each chunk, one after another, and how many counts each has."""
        data, size = np.frombuffer(b"".join(chunks), np.uint8), np.fromiter(map(len, chunks), np.int64, len(chunks))
        first = np.cumsum(size) - size
        letter = latin_letters(data)
        letter[first] |= data[first] == 0x20
        one = np.logical_and.reduceat(letter, first) & (size <= LONGEST)
        rest = array("i")
        for k in np.flatnonzero(~one).tolist():
            raw = chunks[k].decode() if size[k] <= LONGEST else ""
            if raw.isalpha() or raw[:1] == " " and raw[1:].isalpha():
                one[k] = True
            else:
                rest.extend(self.chunk(chunks[k]))
        point = np.append(data[1:], np.uint8(0)) & 0xC0 != 0x80  # the last byte of a code point
        n = np.add.reduceat(point, first, dtype=np.int64)
        out, mine = np.empty(n.sum(), np.int32), np.repeat(one, n)
        if one.any():
            keep = np.repeat(one, size)
            data, point, first = data[keep], point[keep], np.append(0, np.cumsum(size[one]))
            cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(data), PIECE_BYTES)), len(first) - 1))
            counts = [self.pieces_at_once(data[first[a] : first[b]], first[a : b + 1] - first[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            out[mine] = np.concatenate(counts)[point]
        if rest:
            out[~mine] = np.frombuffer(rest, np.int32)
        return out, n

    def plain(self, text: str) -> list[int]:
        """Counts of all code point prefixes of a text in which special strings are ordinary."""
        out: list[int] = []
        base = 0
        for m in self.pieces.finditer(text):
            raw, here = m[0], m.start()
            if self.spaces.fullmatch(raw):
                if here and self.spaces.match(text[here - 1]):
                    continue  # counted with the run that it ends
                run = self.spaces.match(text, here)[0]
                counts = self._points(run)
                out += [base + c for c in counts]
                if here + len(run) == len(text):
                    base += counts[-1]
                elif run[-1] == " ":
                    base += counts[len(run) - 2] if len(run) > 1 else 0
                else:
                    base += (counts[len(run) - 2] if len(run) > 1 else 0) + self._points(run[-1])[-1]
                continue
            counts = self._points(raw)
            if raw in ("'re", "'ve", "'ll"):
                counts = list(counts)
                counts[1] = 2  # the apostrophe and a letter are two pieces until the contraction is whole
            if raw[0] == " ":
                done = here > 0 and self.spaces.match(text[here - 1]) is not None  # that space stands in the run already
                out += [base + c for c in (counts[1:] if done else counts)]
            else:
                out += [base + c for c in counts]
            base += counts[-1]
        return out

    def text(self, text: str) -> np.ndarray:
        """Counts of all code point prefixes of a text, special strings counted as the library does by default."""
        if not self.cut or not self.cut.search(text):
            return np.array(self.plain(text), dtype=np.int32)
        out, base, at = [], 0, 0
        for m in [*self.cut.finditer(text), None]:
            end = m.start() if m else len(text)
            if end > at:
                own = self.plain(text[at:end])
                out += [base + c for c in own]
            else:
                own = [0]
            if m:
                through = self.plain(text[at : m.end() - 1])
                out += [base + c for c in through[end - at :]]
                base += own[-1] + 1
                out.append(base)
                at = m.end()
        return np.array(out, dtype=np.int32)


def _odd_documents(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents with white space beyond ASCII or the start of a special string: chunks may not split these."""
    n = len(data)
    if n < 2:
        return np.zeros(len(offsets) - 1, bool)
    b0, b1 = data[:-1], data[1:]
    b2 = np.append(data[2:], np.uint8(0))
    hit = (b0 == 0x3C) & (b1 == 0x7C)
    if int(data.max()) > 127:
        hit |= (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
        hit |= (b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80)
        hit |= (b0 == 0xE2) & (b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF))
        hit |= (b0 == 0xE2) & (b1 == 0x81) & (b2 == 0x9F)
        hit |= (b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80)
    at = np.flatnonzero(hit)
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, at, side="right") - 1] = True
    return out


class ChunkTable:
    """Integer lists of distinct chunks in flat arrays, made once while they stay in the table."""

    def __init__(self, make, most_bytes: int = TABLE_BYTES):
        self.make, self.most = make, most_bytes
        self._new({})

    def _new(self, kept: dict) -> None:
        old = (self.flat, self.starts, self.sizes) if kept else None
        self.rows: dict[bytes, int] = {}
        self.flat, self.starts, self.sizes, self.seen, self.held = array("i"), array("q"), array("i"), bytearray(), 0
        for k, row in kept.items():
            self._add(k, old[0][old[1][row] : old[1][row] + old[2][row]])

    def _add(self, chunk: bytes, values) -> int:
        row = self.rows[chunk] = len(self.starts)
        self.starts.append(len(self.flat))
        self.flat.extend(values)
        self.sizes.append(len(values))
        self.seen.append(0)
        self.held += ENTRY_BYTES + len(chunk) + 4 * len(values)
        return row

    def _add_all(self, chunks: list[bytes], values: np.ndarray, sizes: np.ndarray) -> range:
        """Add chunks whose lists stand one after another in `values`."""
        rows = range(len(self.starts), len(self.starts) + len(chunks))
        self.rows.update(zip(chunks, rows, strict=True))
        self.starts.frombytes((len(self.flat) + np.cumsum(sizes) - sizes).tobytes())
        self.flat.frombytes(values.tobytes())
        self.sizes.frombytes(sizes.astype(np.int32).tobytes())
        self.seen.extend(bytes(len(chunks)))
        self.held += ENTRY_BYTES * len(chunks) + sum(map(len, chunks)) + 4 * len(values)
        return rows

    def of(self, chunks: list[bytes], index: np.ndarray, make_all=None):
        """The lists of the chunks at `index`, one after another, and where each begins (one more at the end).

        `make_all` makes the lists of many chunks: all of them one after another, and the sizes.
        """
        if self.held > self.most:  # what came up again stays, if that is not too much
            again = {k: r for k, r in self.rows.items() if self.seen[r] and len(k) < 256}
            self._new(again if len(again) < len(self.rows) // 2 else {})
        get = self.rows.get
        rows = np.fromiter((get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(rows < 0)
        if len(new) < len(rows):
            np.frombuffer(self.seen, np.uint8)[rows[rows >= 0]] = 1
        if make_all and len(new):
            fresh = [chunks[i] for i in new.tolist()]
            rows[new] = self._add_all(fresh, *make_all(fresh))
        else:
            for i in new.tolist():
                rows[i] = self._add(chunks[i], self.make(chunks[i]))
        row = rows[index]
        size = np.frombuffer(self.sizes, np.int32)[row]
        first = np.zeros(len(row) + 1, np.int64)
        np.cumsum(size, out=first[1:])
        at = np.arange(first[-1])
        at += np.repeat(np.frombuffer(self.starts, np.int64)[row] - first[:-1], size)
        return np.frombuffer(self.flat, np.int32)[at], first


def _counts_of_block(counter: PrefixCounter, table: ChunkTable, data: np.ndarray, offsets: np.ndarray):
    """Counts at all prefixes of all documents, one after another, and where each document's begin."""
    n = len(offsets) - 1
    odd = _odd_documents(data, offsets)
    values, bounds = np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    if len(data):
        starts = chunk_starts(data, offsets, punctuation=True)
        index, distinct = chunk_dictionary(data, starts)
        values, first = table.of(distinct.to_pylist(), index, counter.chunks)
        chunk_of_doc = np.searchsorted(starts, offsets)
        bounds = first[chunk_of_doc]
        total = values[first[1:] - 1].astype(np.int64)
        before = np.cumsum(total) - total
        doc = np.repeat(np.arange(n), np.diff(chunk_of_doc))
        before -= before[chunk_of_doc[doc]]
        values += np.repeat(before.astype(np.int32), np.diff(first))
    if odd.any():
        parts, raw = [], data.tobytes()
        for k in range(n):
            parts.append(counter.text(raw[offsets[k] : offsets[k + 1]].decode("utf-8")) if odd[k] else values[bounds[k] : bounds[k + 1]])
        values, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return values, bounds


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text", prefixes: bool = False) -> DataFrame:
    """Count the tokens of every whole text, and where a budget of `limit` tokens ends.

    Returns a row per input row: doc_id, n_bytes, n_chars, n_tokens, over_limit (n_tokens > limit), limit_chars (length
    in code points of the longest prefix with at most `limit` tokens) and, with `prefixes`, prefix_tokens (the count
    at each prefix of 1, 2, ... code points). `tokenizer` is the path of a byte-level BPE file of the tokenizers
    library, on every executor. Special strings in a text count as the library does by default.

    A null text counts as an empty one: zero everywhere. A null doc_id stays null; repeated rows give repeated rows;
    an empty table gives none; other columns are ignored, whatever their names. Map-only: no shuffle, and memory is
    bounded by blocks of text and by tables of chunks that start anew when full.
    """
    schema = "doc_id long, n_bytes long, n_chars long, n_tokens long, over_limit boolean, limit_chars long" + ", prefix_tokens array<int>" * prefixes

    def run(batches):
        counter = PrefixCounter(tokenizer)
        table = ChunkTable(counter.chunk)
        for ids, data, offsets in text_blocks(batches, BLOCK):
            values, bounds = _counts_of_block(counter, table, data, offsets)
            sizes = np.diff(bounds)
            full = sizes > 0
            total, fit = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            total[full] = values[bounds[1:][full] - 1]
            if full.any():
                within = np.where(values <= limit, np.arange(1, len(values) + 1), 0)
                fit[full] = np.maximum(np.maximum.reduceat(within, bounds[:-1][full]) - bounds[:-1][full], 0)
            cols = [ids.cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(sizes), pa.array(total), pa.array(total > limit), pa.array(fit)]
            if prefixes:
                cols.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values)))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_chars", "n_tokens", "over_limit", "limit_chars", "prefix_tokens"][: len(cols)])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(freeing(run), schema)


def truncated(counted: DataFrame, budget: int, text: str = "text", prefix_tokens: str = "prefix_tokens") -> DataFrame:
    """Cut texts to the longest prefix within `budget` tokens by the stored prefix counts, with no encoding.

    Adds kept_text and kept_tokens. Null texts stay null with zero tokens. `counted` needs a text and its prefix counts.
    """
    ends = F.filter(F.sequence(F.lit(1), F.size(prefix_tokens)), lambda i: F.element_at(prefix_tokens, i) <= budget)
    fit = F.when(F.size(prefix_tokens) > 0, F.coalesce(F.array_max(ends), F.lit(0))).otherwise(F.lit(0))
    return counted.withColumn("kept_chars", fit).withColumns({
        "kept_text": F.substring(F.col(text), F.lit(1), F.col("kept_chars")),
        "kept_tokens": F.when(F.col("kept_chars") > 0, F.element_at(prefix_tokens, F.col("kept_chars").cast("int"))).otherwise(F.lit(0)),
    })
