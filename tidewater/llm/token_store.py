"""Token files: an adaptive context-mixing range coder for token ids.

A token file is a table of segments. A segment holds whole documents and is cut into
blocks of BLOCK ids. Every block starts from the same state, so any block decodes on
its own, and has a checksum of its ids. Many blocks of a segment are coded in step:
one vector operation does the same step of each block.

The model
---------
Ids fall into 256 groups by frequency: the 192 most frequent ids are groups of their
own, the others share 64 groups of like weight. An id is coded as its group and then,
where the group has more members, as the member.

* order 0: the segment's frequency of each id, as that of its group times its own
  within the group;
* order 1: the segment's frequencies of groups behind the group before;
* order 2: the group that last followed the two before, in this block.

The segment's head has the order-0 and order-1 counts that all its blocks start
from; counts are rounded to four bits, and order 1 is left out where it would cost
more than it saves. A group's interval is cut from the weighted sum of the three
orders' cumulative frequencies. The weights are learnt within a block, id by id:
order 2's from how often it was right lately; order 1's against order 0's by the
likelihood that either gave the id, at every fourth id.

Defined results
---------------
* a null or empty text is the end id alone; special tokens in a text are encoded as
  the tokenizer does by itself;
* texts of any length are encoded whole; a segment's blocks are coded LANES at a
  time at most, so a long document needs no more memory than its ids;
* documents stand in ascending id order, null ids first; rows of one id by a hash
  of their text; repeated rows are written as often as they occur;
* a payload whose header, words or ids do not match their checksums raises ValueError;
* an empty table gives an empty table of segments; other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm._shared import small_batches, staged

END = 2
#: Ids of a block; blocks that are coded in step at most; ids after which a segment ends with its document.
BLOCK, LANES, SEGMENT = 1024, 8192, 1 << 22
MAGIC, VERSION = b"TWTK", 2
_HEAD = struct.Struct("<4sBHQIII")

_SINGLES, _GROUPS = 192, 256
#: The sum of all groups' frequencies, of a group's members', and what each group has of the first at least.
_ALL, _MEMBERS, _LEAST = 1 << 20, 1 << 16, 16
#: Weights of order 1 that tables are mixed for; slots of a block's order-2 table; how fast weights adapt.
_LEVELS, _SLOTS, _RATE, _GAIN = 16, 512, np.float32(1 / 16), 4
_2_16, _2_20, _2_32, _2_48 = 2.0**16, 2.0**20, 2.0**32, 2.0**48


def _coarse(n: np.ndarray) -> np.ndarray:
    """Counts as bytes: four significant bits and an exponent."""
    e = np.maximum(np.frexp(n.astype(np.float64))[1] - 4, 0)
    return (8 * e + (n >> e)).astype(np.uint8)


def _counts_of(q: np.ndarray) -> np.ndarray:
    q = q.astype(np.int64)
    e = np.maximum(q // 8 - 1, 0)
    return np.where(q < 16, q, (8 + q % 8) << e)


class Tables:
    """The frequencies that a segment's blocks start from.

    alphabet: the segment's ids, most frequent first; counts: theirs, not rising;
    follow: [group, group] counts of what follows what, if any.
    """

    def __init__(self, alphabet: np.ndarray, counts: np.ndarray, follow: np.ndarray | None = None) -> None:
        n = len(alphabet)
        self.alphabet = alphabet.astype(np.int64)
        self.rank = np.zeros(65536, np.int64)
        self.rank[alphabet] = np.arange(n)
        rest = np.cumsum(counts[_SINGLES:])
        shared = (rest - 1) * (_GROUPS - _SINGLES) // rest[-1] if len(rest) else rest
        self.group = g = np.r_[np.arange(min(n, _SINGLES)), _SINGLES + shared].astype(np.int64)
        self.size = np.bincount(g, minlength=_GROUPS)
        self.first = np.cumsum(self.size) - self.size
        total = np.bincount(g, counts, _GROUPS).astype(np.int64)
        # members of a group: cumulative shares of it, each 1 at least
        sums, at = np.r_[0, np.cumsum(counts)], np.arange(n) - self.first[g]
        base, room = sums[self.first[g]], _MEMBERS - self.size[g]
        self.start = (sums[:-1] - base) * room // total[g] + at
        self.end = (sums[1:] - base) * room // total[g] + at + 1
        share, least = _ALL - _LEAST * _GROUPS, _LEAST * np.arange(_GROUPS + 1)
        plain = np.r_[0, np.cumsum(total)] * share // total.sum() + least
        behind = np.tile(plain, (_GROUPS, 1))
        if follow is not None:  # a context's counts, and one more that is dealt as all groups are
            scaled = np.cumsum(follow * 65536 + total * 65536 // total.sum(), axis=1)
            behind[:, 1:] = scaled * share // np.maximum(scaled[:, -1:], 1) + least[1:]
        level = 2 * np.arange(_LEVELS)[:, None, None] + 1
        self.mixed = ((level * behind + (2 * _LEVELS - level) * plain) // (2 * _LEVELS)).astype(np.int32).ravel()
        self.ratio = ((np.diff(behind, axis=1) + 1) / (np.diff(plain) + 1)).astype(np.float32).ravel()

    def groups(self, ids: np.ndarray) -> np.ndarray:
        return self.group[self.rank[ids]]


def tables_of(rows: np.ndarray) -> tuple[Tables, bytes]:
    """The tables of a segment's blocks, and their packed form."""
    n = np.bincount(rows.ravel(), minlength=65536)
    present = np.flatnonzero(n)
    order = np.argsort(-n[present], kind="stable")
    alphabet = present[order]
    q = _coarse(n[alphabet])
    own = alphabet.astype("<u2").tobytes() + q.tobytes()
    t = Tables(alphabet, _counts_of(q))
    g = t.groups(rows)
    before = np.concatenate([np.zeros((len(rows), 1), np.int64), g[:, :-1]], axis=1)
    pairs = np.bincount((before * _GROUPS + g).ravel(), minlength=_GROUPS**2).reshape(_GROUPS, _GROUPS)
    follow = _coarse(pairs)
    cost, alone = len(zlib.compress(follow.tobytes())), pairs.sum(0)
    by = np.outer(pairs.sum(1), alone)
    seen = pairs > 0
    saved = (pairs[seen] * np.log2(pairs[seen] * float(rows.size) / by[seen])).sum() / 8
    if saved > cost:
        return Tables(alphabet, _counts_of(q), _counts_of(follow)), zlib.compress(own + follow.tobytes())
    return t, zlib.compress(own)


def unpacked_tables(packed: bytes, n: int) -> Tables:
    """The tables of `n` different ids from their packed form."""
    raw = zlib.decompress(packed)
    alphabet, q = np.frombuffer(raw, "<u2", n).astype(np.int64), np.frombuffer(raw, np.uint8, n, 2 * n)
    follow = np.frombuffer(raw, np.uint8, _GROUPS**2, 3 * n).reshape(_GROUPS, _GROUPS) if len(raw) > 3 * n else None
    return Tables(alphabet, _counts_of(q), None if follow is None else _counts_of(follow))


class _Mix:
    """The adaptive state of `lanes` blocks that are coded in step."""

    def __init__(self, t: Tables, lanes: int) -> None:
        self.t, lane = t, np.arange(lanes)
        self.seen, self.base = np.zeros(lanes * _SLOTS, np.uint8), lane * _SLOTS  # the groups that followed
        self.odd = np.full(lanes, 512, np.int32)  # that order 2 is right, of 32768
        self.weight = np.full(lanes, 0.75, np.float32)  # of order 1, against order 0
        self.last = self.last2 = np.zeros(lanes, np.int64)
        self.steps = 0
        self._level()

    def _level(self) -> None:
        self.level = (self.weight * np.float32(_LEVELS)).astype(np.int64) * (_GROUPS * (_GROUPS + 1))

    def look(self) -> None:
        """What order 2 foretells next, and the weights of all."""
        self.at = self.base + ((self.last * 40503 ^ self.last2 * 60493) >> 3 & _SLOTS - 1)
        self.two = self.seen.take(self.at, mode="clip").astype(np.int64)
        share = self.odd * 15 >> 11  # of 256, 240 at most
        self.others, self.twos = 256 - share, share * (_ALL >> 8)
        self.row = self.level + self.last * (_GROUPS + 1)

    def _rest(self, at: np.ndarray) -> np.ndarray:
        return self.t.mixed.take(at, mode="clip") * self.others >> 8

    def below(self, g: np.ndarray) -> np.ndarray:
        """The mixed frequency of all groups before g."""
        return self._rest(self.row + g) + (g > self.two) * self.twos

    def group_at(self, v: np.ndarray) -> np.ndarray:
        """The group whose interval holds v.

        Behind the foretold group order 2's share is taken off, so that what is left
        is a search in the table of orders 0 and 1.
        """
        at = self.row + self.two
        behind = v >= self._rest(at + 1) + self.twos
        foretold = (v >= self._rest(at)) & ~behind
        limit = (((v - behind * self.twos + 1) * 256.0 - 1) / self.others).astype(np.int32)
        at = self.row
        for jump in (128, 64, 32, 16, 8, 4, 2, 1):
            at = at + (self.t.mixed.take(at + jump, mode="clip") <= limit) * jump
        at = at - self.row
        return at + foretold * (self.two - at)

    def learn(self, g: np.ndarray) -> None:
        if self.steps & 3 == 0:  # every fourth id is enough for this weight
            likely = self.t.ratio.take(self.last * _GROUPS + g, mode="clip") * self.weight
            posterior = likely / (likely + (np.float32(1) - self.weight))
            self.weight = np.minimum(self.weight + (posterior - self.weight) * _RATE, np.float32(0.999))
            self._level()
        self.steps += 1
        hit = g == self.two
        self.odd += (hit * np.int32(32767) - self.odd) >> _GAIN
        self.seen[self.at] = g.astype(np.uint8)
        self.last2, self.last = self.last, g


def _carried(out: np.ndarray) -> np.ndarray:
    """Rows of words of 16 bits from words that may have one bit more, which belongs to the word before."""
    carry = out >> np.uint32(16)
    while carry.any():
        out &= np.uint32(0xFFFF)
        out[:, :-1] += carry[:, 1:]
        carry = out >> np.uint32(16)
    return out


def encode_blocks(ids: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts) for rows of ids: each block's 16-bit words, one block after the other, and their number.

    A lane's interval is [low, low + width), whole numbers below 2**49 in floats;
    width is 2**32 at least before each step. After it, words go out until that is so
    again; a word may have a bit more than 16, which _carried() adds to the word before.
    """
    lanes, steps = ids.shape
    m = _Mix(t, lanes)
    low, width = np.zeros(lanes), np.full(lanes, _2_48)
    out = np.zeros((lanes, steps * 3 + 2), np.uint32)
    flat, begin = out.reshape(-1), np.arange(lanes) * out.shape[1]
    pos = begin.copy()

    def put(low: np.ndarray, width: np.ndarray, lanes_of: np.ndarray | None = None) -> None:
        go = np.flatnonzero(width < _2_32)
        while len(go):
            lane = go if lanes_of is None else lanes_of.take(go)
            part, at, wi = low.take(go), pos.take(lane), width.take(go) * _2_16
            word = np.floor(part * (1 / _2_32))
            flat[at] = word
            pos[lane] = at + 1
            low[go], width[go] = (part - word * _2_32) * _2_16, wi
            go = go[wi < _2_32]

    for r in t.rank[np.ascontiguousarray(ids.T)]:
        g = t.group.take(r)
        m.look()
        start, end = m.below(g), m.below(g + 1)
        unit = np.floor(width * (1 / _2_20))
        low += unit * start
        width = unit * (end - start)
        m.learn(g)
        put(low, width)
        more = np.flatnonzero(t.size.take(g) > 1)
        if len(more):
            x = r.take(more)
            start, unit = t.start.take(x), np.floor(width.take(more) * (1 / _2_16))
            lo, wi = low.take(more) + unit * start, unit * (t.end.take(x) - start)
            put(lo, wi, more)
            low[more], width[more] = lo, wi
    flat[pos] = np.ceil(low * (1 / _2_32))  # the words behind it are read as zeros
    counts = pos + 1 - begin
    out = _carried(out[:, : counts.max()])
    return out[np.arange(out.shape[1])[None, :] < counts[:, None]].astype(np.uint16), counts


def decode_blocks(words: np.ndarray, counts: np.ndarray, steps: int, t: Tables) -> np.ndarray:
    """The rows of ids that encode_blocks() was given."""
    lanes = len(counts)
    m = _Mix(t, lanes)
    wide = int(counts.max()) + 4
    padded = np.zeros((lanes, wide), np.uint16)
    padded[np.arange(wide)[None, :] < counts[:, None]] = words
    flat, pos = padded.reshape(-1), np.arange(lanes) * wide
    code, width = flat[pos] * _2_32 + flat[pos + 1] * _2_16 + flat[pos + 2], np.full(lanes, _2_48)
    pos += 3
    deep = [1 << k for k in reversed(range(int(t.size.max() - 1).bit_length()))]
    last_of = t.first + t.size - 1
    out = np.zeros((steps, lanes), np.uint16)

    def get(code: np.ndarray, width: np.ndarray, lanes_of: np.ndarray | None = None) -> None:
        go = np.flatnonzero(width < _2_32)
        while len(go):
            lane = go if lanes_of is None else lanes_of.take(go)
            at, wi = pos.take(lane), width.take(go) * _2_16
            code[go], width[go] = code.take(go) * _2_16 + flat.take(at, mode="clip"), wi
            pos[lane] = at + 1
            go = go[wi < _2_32]

    for k in range(steps):
        m.look()
        unit = np.floor(width * (1 / _2_20))
        g = m.group_at(np.minimum(code / unit, _ALL - 1).astype(np.int32))
        start = m.below(g)
        code -= unit * start
        width = unit * (m.below(g + 1) - start)
        m.learn(g)
        get(code, width)
        r = t.first.take(g)
        more = np.flatnonzero(t.size.take(g) > 1)
        if len(more):
            co, wi, x, most = code.take(more), width.take(more), r.take(more), last_of.take(g.take(more))
            unit = np.floor(wi * (1 / _2_16))
            v = np.minimum(np.floor(co / unit), _MEMBERS - 1)
            for jump in deep:
                y = np.minimum(x + jump, most)
                x = np.where(t.start.take(y) <= v, y, x)
            start = t.start.take(x)
            co -= unit * start
            wi = unit * (t.end.take(x) - start)
            get(co, wi, more)
            code[more], width[more], r[more] = co, wi, x
        out[k] = t.alphabet.take(r, mode="clip")
    return out.T


def _lane_groups(n: int) -> list[tuple[int, int]]:
    """Blocks that are coded in step, LANES at most, as ranges of like size."""
    parts = -(-n // LANES)
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


def encode_segment(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A payload: head, document lengths, each block's word count and checksum, tables, checksums of these and of the words, words.

    ids: below 65536; lengths: ids of each document, in order.
    """
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("an id is above 65535")
    n = -(-len(ids) // BLOCK)
    rows = np.full(n * BLOCK, ids[-1] if n else 0, np.uint16)
    rows[: len(ids)] = ids
    rows = rows.reshape(n, BLOCK)
    words, counts, tables, kinds = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)], b"", 0
    if n:
        t, tables = tables_of(rows)
        kinds = len(t.alphabet)
        for a, b in _lane_groups(n):
            w, c = encode_blocks(rows[a:b], t)
            words.append(w)
            counts.append(c)
    wide = np.asarray(ids).astype("<u4")
    sums = np.array([zlib.crc32(wide[i * BLOCK : (i + 1) * BLOCK].tobytes()) for i in range(n)], dtype="<u4")
    head = _HEAD.pack(MAGIC, VERSION, BLOCK, len(ids), len(lengths), kinds, len(tables))
    head += lengths.astype("<u4").tobytes() + np.concatenate(counts).astype("<u2").tobytes() + sums.tobytes() + tables
    coded = np.concatenate(words).astype("<u2").tobytes()
    return head + struct.pack("<II", zlib.crc32(head), zlib.crc32(coded)) + coded


def head_size(payload: bytes) -> int:
    """Bytes before a payload's words."""
    _, _, block, n_ids, n_docs, _, packed = _HEAD.unpack_from(payload)
    return _HEAD.size + 4 * n_docs + 6 * -(-n_ids // block) + packed + 8


def decode_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of a payload."""
    try:
        magic, version, block, n_ids, n_docs, kinds, packed = _HEAD.unpack_from(payload)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token segment")
        n, at, end = -(-n_ids // block), _HEAD.size, head_size(payload)
        if struct.unpack_from("<II", payload, end - 8) != (zlib.crc32(payload[: end - 8]), zlib.crc32(payload[end:])):
            raise ValueError("a token segment's head or words do not match their checksums")
        lengths = np.frombuffer(payload, "<u4", n_docs, at).astype(np.int64)
        counts = np.frombuffer(payload, "<u2", n, at := at + 4 * n_docs).astype(np.int64)
        sums = np.frombuffer(payload, "<u4", n, at := at + 2 * n)
        words = np.frombuffer(payload, "<u2", int(counts.sum()), end)
    except (struct.error, ValueError, ZeroDivisionError) as e:
        raise ValueError(f"bad token segment: {e}") from e
    if not n:
        return np.zeros(0, "<u4"), lengths
    t = unpacked_tables(payload[at + 4 * n : at + 4 * n + packed], kinds)
    first, rows = np.r_[0, np.cumsum(counts)], []
    with np.errstate(all="ignore"):  # of blocks that are broken
        for a, b in _lane_groups(n):
            rows.append(decode_blocks(words[first[a] : first[b]], counts[a:b], block, t))
    ids = np.concatenate(rows).reshape(-1)[:n_ids].astype("<u4")
    for i in range(n):
        if zlib.crc32(ids[i * block : (i + 1) * block].tobytes()) != sums[i]:
            raise ValueError(f"block {i} of a token segment does not match its checksum")
    return ids, lengths


class _Kept(dict):
    """What has been made of keys; of more than `most`, those not asked for lately are made anew."""

    def __init__(self, most: int, make: Callable) -> None:
        self.most, self.make, self.older = most, make, {}

    def __missing__(self, key):
        made = self.older.pop(key, None)
        if made is None:
            made = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = made
        return made


#: A tokenizer of this kind encodes a text piece by piece, white space and case aside (fixed values of its file).
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Words of ASCII and Latin-1 letters are in NFC, and lower-casing keeps them so; _CUT is this pattern for them.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
#: The sign that stands for each byte in a byte-level vocabulary.
_SIGN = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}

#: Bytes of text encoded at a time; the ASCII spaces; masks of a word's three times eight bytes by its length; odd multipliers.
_CHUNK = 1 << 19
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_FIRST = [np.array([(1 << 8 * min(max(n - 8 * k, 0), 8)) - 1 for n in range(26)], np.uint64) for k in range(3)]
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Words:
    """A tokenizer that keeps the ids of words and of pieces of words that it has met.

    Where the tokenizer lower-cases, drops white space and cuts words into pieces by
    _CUT, each piece is encoded by its model on its own; so a text's ids are those of
    its pieces, one after the other. Words with other signs than ASCII and Latin-1
    letters, texts with special tokens, and texts for other tokenizers are given to
    the library as they are.
    """

    def __init__(self, tokenizer: Tokenizer, most: int = 1_200_000) -> None:
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.most, self.bits = most, 21
        self._forget()
        told = json.loads(tokenizer.to_str())
        cuts = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_words = (
            (told["normalizer"] or {}).get("normalizers") == _NORMAL
            and cuts[0].get("pattern") == {"Regex": _CUT}
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and not cuts[1]["add_prefix_space"]
            and told["model"]["type"] == "BPE"
        )
        self.marks = [t["content"].encode() for t in told["added_tokens"]]
        self.pieces = _Kept(most // 3, self._piece)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").astype("<u2").tobytes()

    def _piece(self, piece: bytes) -> bytes:
        signs = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(_SIGN)
        return array("H", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():
            return self.pieces[word]
        if word[-1] in b".,;:!?" and word[:-1].isalpha():
            return self.pieces[word[:-1]] + self.pieces[word[-1:]]
        text = word.decode("utf-8", "replace")
        return b"".join([self.pieces[p.encode()] for p in _PIECES(text.lower())]) if _PLAIN(text) else self._whole(text)

    def _forget(self) -> None:
        """Start with an empty table of words; pieces stay known."""
        self.table = np.zeros((1 << self.bits, 4), np.uint64)
        self.kept, self.long, self.count, self.used = np.zeros(1 << 16, np.uint16), {}, 0, 0

    def _learn(self, words: list[bytes]) -> list[int]:
        """Puts the ids of words behind those kept; where they are: place << 16 | number."""
        found = list(map(self._word, words))
        n = np.fromiter(map(len, found), np.int64, len(found)) // 2
        if n.max(initial=0) > 0xFFFF:
            raise ValueError("a word has over 65535 ids")
        ids = np.frombuffer(b"".join(found), np.uint16)
        if self.used + len(ids) > len(self.kept):
            self.kept = np.r_[self.kept[: self.used], np.zeros(len(self.kept) + 2 * len(ids), np.uint16)]
        self.kept[self.used : self.used + len(ids)] = ids
        places = self.used + np.cumsum(n) - n
        self.used += len(ids)
        self.count += len(words)
        return ((places << 16) + n).tolist()

    def _places(self, data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each word of data the place of its ids among those kept.

        The table holds words of up to 24 bytes as three numbers and their place, and
        is probed for all words at once.
        """
        at8 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        short = np.minimum(size, 25)
        key = [at8.take(start + 8 * k) & _FIRST[k].take(short) for k in range(3)]
        h = key[0] * _ODD[0] ^ (key[1] * _ODD[1] ^ key[2] * _ODD[2])
        slot = ((h ^ h >> np.uint64(29)) * _ODD[3] >> np.uint64(64 - self.bits)).astype(np.int64)
        out, mask = np.full(len(start), -1, np.int64), (1 << self.bits) - 1
        on = np.flatnonzero(size <= 24)
        at = slot.take(on)
        k0, k1, k2 = (k.take(on) for k in key)
        while len(on):
            row = self.table.take(at, axis=0)
            same = (row[:, 0] == k0) & (row[:, 1] == k1) & (row[:, 2] == k2) & (row[:, 3] > 0)
            out[on[same]] = row[same, 3].astype(np.int64) - 1
            go = np.flatnonzero(~same & (row[:, 3] > 0))
            on, at, k0, k1, k2 = on[go], at[go] + 1 & mask, k0[go], k1[go], k2[go]
        on = np.flatnonzero(out < 0)
        names = [data[a:b] for a, b in zip(start[on].tolist(), (start + size)[on].tolist(), strict=True)]
        new = [w for w in dict.fromkeys(names) if w not in self.long]
        made = dict(zip(new, self._learn(new), strict=True))
        self.long.update((w, made[w]) for w in new if len(w) > 24)
        out[on] = [made[w] if w in made else self.long[w] for w in names]
        on = on[size[on] <= 24]
        at, rows = slot.take(on), np.stack([*(k.take(on) for k in key), (out[on] + 1).astype(np.uint64)], axis=1)
        while len(at):
            free = self.table[at, 3] == 0
            self.table[at[free]] = rows[free]  # of different words for one slot the last stays
            go = np.flatnonzero((self.table[at] != rows).any(1))
            at, rows = at[go] + 1 & mask, rows[go]
        return out

    def _some(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b" ".join(texts).lower() + b" " * 32
        space = _SPACE[np.frombuffer(data, np.uint8)]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = edge if space[0] else np.r_[0, edge]
        start, end = edge[::2], edge[1::2]
        if self.count > self.most:
            self._forget()
        place = self._places(data, start, end - start)
        n = place & 0xFFFF
        before = np.cumsum(n) - n
        ids = self.kept.take(np.repeat((place >> 16) - before, n) + np.arange(n.sum()))
        of_text = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        cut = np.r_[before, len(ids)].take(of_text)
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of texts in UTF-8."""
        out: list[np.ndarray] = []
        some: list[bytes] = []
        size = 0
        for t in texts:
            alone = not self.by_words or any(m in t for m in self.marks)
            if some and (alone or size + len(t) > _CHUNK):
                out += self._some(some)
                some, size = [], 0
            if alone:
                out.append(np.frombuffer(self._whole(t.decode("utf-8", "replace")), "<u2"))
            else:
                some.append(t)
                size += len(t)
        return out + (self._some(some) if some else [])


@cache
def _words_of(tokenizer: str) -> Words:
    """A Python worker's words, so that one task's serve the next. It must stay a function of the module: what write() defines is made anew for each task."""
    return Words(Tokenizer.from_str(tokenizer))


def write(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """The table of segments: (part int, seg int, before long, n_ids long, doc_ids array, payload binary).

    tokenizer: the library's JSON. before: ids of the same part in earlier segments.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    small_batches(spark)
    told = spark.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words_of(told.value)
        names, ids, held, size, before, seg, part = [], None, [], 0, 0, 0, 0

        def out() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held])
            payload = encode_segment(np.concatenate(held), lengths)
            values = ((part, pa.int32()), (seg, pa.int32()), (before, pa.int64()), (size, pa.int64()), (names, pa.list_(ids)), (payload, pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["part", "seg", "before", "n_ids", "doc_ids", "payload"])

        for b in batches:
            ids = b.column(1).type
            found = words.encode([t or b"" for t in b.column(2).to_pylist()])
            for p, i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), found, strict=True):
                part = p
                names.append(i)
                held.append(np.append(x, np.uint16(end)))
                size += len(x) + 1
                if size >= SEGMENT:
                    yield out()
                    before, seg = before + size, seg + 1
                    names, held, size = [], [], 0
        if held:
            yield out()

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("t"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h").select(F.spark_partition_id().alias("part"), "id", "t")
    return staged(dealt.mapInArrow(run, f"part int, seg int, before long, n_ids long, doc_ids array<{kind}>, payload binary"), "tokens")


def read(segments: DataFrame) -> DataFrame:
    """(id, start long, n_tokens long, ids_crc32 long) of each document, decoded from the payloads.

    Only the parts' totals are joined to the segments; there is one a part, and
    parts are no more than the shuffle partitions they were written with.
    """
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = segments.join(F.broadcast(base), F.col("part") == F.col("p")).select((F.col("base") + F.col("before")).alias("start"), "doc_ids", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, names, payload in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ids, lengths = decode_segment(payload.as_py())
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([names.values, pa.array(start + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")
