"""Token ids of texts by a public tokenizer's file, with a bounded cache of the ids of pieces of text."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import kept

#: Entries after which a generation of a worker's cache ends; what the next one doesn't use is forgotten.
CACHE = 400_000
#: Bytes of text that are encoded together; longer texts are cut between words.
PART = 4 << 20
LETTER, DIGIT, MARK, SPACE = 0, 1, 2, 3
#: The first byte of the letters U+00C0 to U+00FF, and the second byte of the two characters there that are no letters.
LATIN, NO_LETTERS = 0xC3, (0x97, 0xB7)


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: its class, its lower case in ASCII, and whether it keeps a word from being cut into pieces."""
    b = np.arange(256)
    ascii_letter = (b >= 65) & (b <= 90) | (b >= 97) & (b <= 122)
    kind = np.where(ascii_letter | (b >= 0x80), LETTER, np.where((b >= 48) & (b <= 57), DIGIT, MARK))
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    whole = (b < 32) & (kind != SPACE) | (b == 127) | (b == ord("'")) | (b >= 0xC0) & (b != LATIN)
    return kind.astype(np.uint8), np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8), whole


KIND, LOWERED, WHOLE = tables()


class Encoder:
    """Ids as little-endian unsigned 32-bit integers.

    The tokenizer lower-cases, drops white space, never joins what stands on both sides of it, and takes runs
    of letters, single digits and runs of marks by themselves. So words of plain letters, digits and marks
    are lower-cased and cut into such pieces; words with apostrophes (which may begin a contraction), control
    characters or characters outside Latin-1 (which normalising may change) are one piece each. Pieces repeat,
    so each different one is encoded once, and a text's ids are those of its pieces, one after another.
    """

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.known, self.old = Tokenizer.from_file(path), {}, {}
        # lower-cased words of plain letters need no normalising and only white space splits them
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # words that hold how an added token begins are one piece each
        self.added = sorted({t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        n = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(n)])

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("").cast(pa.large_binary())
        n = len(texts)
        if not n:
            return []
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        first, last = int(bounds[0]), int(bounds[-1])
        if first == last:
            return [b""] * n
        data, bounds = np.frombuffer(texts.buffers()[2], np.uint8)[first:last], bounds - first
        out: list[list[bytes]] = [[] for _ in range(n)]
        lo = 0
        while lo < len(data):
            hi = self.cut(data, bounds, lo)
            a, b = int(np.searchsorted(bounds, lo, "right")) - 1, int(np.searchsorted(bounds, hi, "left"))
            edges = np.clip(bounds[a : b + 1], lo, hi) - lo
            ids, at = self.encode_part(data[lo:hi], edges)
            for k, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                if i < j:
                    out[a + k].append(ids[i:j].tobytes())
            lo = hi
        return [b"".join(x) for x in out]

    @staticmethod
    def cut(data: np.ndarray, bounds: np.ndarray, lo: int, part: int | None = None) -> int:
        """Where the part that begins at lo ends: at a text's end or a space, near PART bytes if there is one."""
        hi = lo + (part or PART)
        if hi >= len(data):
            return len(data)
        k = int(np.searchsorted(bounds, hi, "right")) - 1
        if bounds[k] > lo:
            return int(bounds[k])
        spaces = np.flatnonzero(KIND[data[lo + 1 : hi]] == SPACE)
        if len(spaces):
            return lo + 1 + int(spaces[-1])
        spaces = np.flatnonzero(KIND[data[hi : bounds[k + 1]]] == SPACE)
        return hi + int(spaces[0]) if len(spaces) else int(bounds[k + 1])

    def encode_part(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie one after another between the edges, and where those of each begin."""
        pieces, starts = self.pieces(data, edges)
        coded = pieces.dictionary_encode()
        found = self.ids_of(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(sizes) - sizes
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begins[code] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(starts, edges, "left")]

    def pieces(self, data: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pieces of the texts and where each begins."""
        kind = KIND[data]
        solid = kind != SPACE
        new = np.ones(len(data), bool)  # the class changes, or a text begins
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        opens = np.zeros(len(data), bool)
        opens[edges[edges < len(data)]] = True
        opens[1:] |= ~solid[:-1]
        opens &= solid
        words = np.flatnonzero(opens)
        latin = np.zeros(len(data), bool)
        np.equal(data[:-1], LATIN, out=latin[1:])
        whole = WHOLE[data] | latin & ((data == NO_LETTERS[0]) | (data == NO_LETTERS[1]))
        for pair in self.added:
            whole[:-1] |= (data[:-1] == pair[0]) & (data[1:] == pair[-1])
        lowered = LOWERED[data] + np.uint8(32) * (latin & (data <= 0x9E))
        cuts = new | (kind == DIGIT)
        stuck = np.unique(np.searchsorted(words, np.flatnonzero(whole), "right") - 1)
        if len(stuck):  # these words stay as they are
            mark = np.zeros(len(data) + 1, np.int8)
            mark[words[stuck]] += 1
            mark[np.append(words, len(data))[stuck + 1]] -= 1
            inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
            cuts &= ~inside
            np.copyto(lowered, data, where=inside)
        starts = np.flatnonzero(opens | cuts & solid)
        place = np.cumsum(solid, dtype=np.int32)
        offsets = np.append(place[starts] - 1, place[-1] if len(place) else 0).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(lowered[solid])]), starts

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) > self.cache:
            self.known, self.old = {}, self.known
        known, old, new = self.known, self.old, []
        for p in pieces:
            if p not in known:
                if (ids := old.get(p)) is None:
                    new.append(p)
                else:
                    known[p] = ids
        self.learn(new)
        return list(map(known.__getitem__, pieces))

    def learn(self, new: list[bytes]) -> None:
        words, rest = [], []
        for p in new:  # of plain pieces, those of letters; what is one piece with other characters goes to the full tokenizer
            (words if p.isalpha() or KIND[p[0]] == LETTER and not WHOLE[np.frombuffer(p, np.uint8)].any() and p.decode().isalpha() else rest).append(p)
        for at in range(0, len(words), 10_000):  # a word's last id, and no other, ends a word
            some = words[at : at + 10_000]
            ids = np.asarray(self.plain.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) != len(some):
                rest += some
                continue
            data = ids.tobytes()
            self.known.update({p: data[a:b] for p, a, b in zip(some, [0, *cuts], cuts)})
        for at in range(0, len(rest), 10_000):
            some = rest[at : at + 10_000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)):
                self.known[p] = np.asarray(e.ids, dtype="<u4").tobytes()


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """A worker process keeps its encoder from task to task."""
    return kept((path, cache), lambda: Encoder(path, cache))
