"""Byte-level BPE ids of many texts: texts are cut into pretokens in numpy, and each distinct pretoken is encoded once."""

from __future__ import annotations

from array import array

import numpy as np

from chronofeat.llm.textnum import U, mix

#: Most pretokens kept by a worker.
CACHE = 1_200_000
SPACE, BLANK, LETTER, DIGIT, OTHER, UNSAFE = range(6)


def classes() -> np.ndarray:
    """Of code points below 0x180; all others, and what isn't plain there, is left to the library."""
    t = np.full(0x180, UNSAFE, dtype=np.uint8)
    t[0x21:0x7F] = OTHER
    t[0x30:0x3A] = DIGIT
    t[0x41:0x5B] = t[0x61:0x7B] = t[0xC0:0x180] = LETTER
    t[0xD7] = t[0xF7] = UNSAFE
    t[[0x09, 0x0A, 0x0D]] = BLANK
    t[0x20] = SPACE
    return t


def pretoken_starts(c: np.ndarray, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pretokens start, given code points, their classes and where texts start (flags): contractions, an optional space and a run of one kind, or white space."""
    n = len(c)
    white = cls <= BLANK
    kind = np.where(white, 0, cls)
    new_run = first.copy()
    new_run[1:] |= kind[1:] != kind[:-1]
    last = np.ones(n, dtype=bool)  # of its text
    last[:-1] = first[1:]
    before_word = np.zeros(n, dtype=bool)  # white space right before something else
    before_word[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    starts = new_run | before_word
    after_space = np.zeros(n, dtype=bool)
    after_space[1:] = before_word[:-1] & (cls[:-1] == SPACE)
    starts &= ~after_space
    quote = np.flatnonzero((c == 0x27) & starts & ~last)
    quote = quote[cls[quote + 1] == LETTER]
    if len(quote):
        one = np.isin(c[quote + 1], [ord(x) for x in "stmd"])
        has_two = quote + 2 < n
        second = np.where(has_two, c[np.minimum(quote + 2, n - 1)], 0)
        fits = has_two & ~first[np.minimum(quote + 2, n - 1)]
        two = fits & (((c[quote + 1] == ord("r")) & (second == ord("e"))) | ((c[quote + 1] == ord("v")) & (second == ord("e"))) | ((c[quote + 1] == ord("l")) & (second == ord("l"))))
        q, size = np.concatenate((quote[one], quote[two])), np.concatenate((np.full(one.sum(), 2), np.full(two.sum(), 3)))
        starts[q + 1] = False
        end = q + size
        inner = end < n
        end = end[inner]
        end = end[~first[end] & (cls[end] == LETTER)]
        starts[end] = True
    return np.flatnonzero(starts)


def quick_encoder(path: str):
    """str -> ids for single pretokens, from the merges of the tokenizers file itself; None if its ids don't follow its merges."""
    import json

    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    order = [ids[m] for m in merges]
    if order != sorted(order):
        return None
    level = ByteLevel(add_prefix_space=False, use_regex=False)
    # Every byte but those that UTF-8 never holds occurs in the encoding of some code point below.
    byte_of = {}
    for point in [*range(0x250), *range(0x800, 0xD800, 0x40), *range(0xE000, 0x110000, 0x1000)]:
        for mark, byte in zip(level.pre_tokenize_str(chr(point))[0][0], chr(point).encode(), strict=True):
            byte_of[mark] = byte
    ranks = {bytes(byte_of[x] for x in token): i for token, i in ids.items() if all(x in byte_of for x in token)}
    known = [i for token, i in ids.items() if len(token) == 1]
    if len(known) < 256:
        return None
    for token, i in ids.items():  # single bytes that no text holds, so that all ranks are there
        if len(token) == 1 and token not in byte_of:
            spare = next(x for x in range(256) if x not in byte_of.values())
            byte_of[token] = spare
            ranks[bytes([spare])] = i
    return tiktoken.Encoding("pretokens", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Of one worker: a tokenizer file and what it has encoded so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.seen: dict[int, bytes] = {}
        self.cls = classes()
        self.quick = quick_encoder(path) or (lambda word: self.tok.encode(word, add_special_tokens=False).ids)

    def pretoken(self, word: str) -> bytes:
        return array("I", self.quick(word)).tobytes()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text; together the texts should be a few MB."""
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
        safe = [bool(len(p)) and bool((self.cls[np.minimum(p, 0x17F)] != UNSAFE).all()) and int(p.max()) < 0x180 for p in points]
        out: list = [None] * len(texts)
        hard = [i for i, ok in enumerate(safe) if not ok]
        for i, ids in zip(hard, self.whole([texts[i] for i in hard]) if hard else [], strict=True):
            out[i] = ids
        easy = [i for i, ok in enumerate(safe) if ok]
        if not easy:
            return out
        c = np.concatenate([points[i] for i in easy])
        begin = np.concatenate(([0], np.cumsum([len(points[i]) for i in easy])))
        first = np.zeros(len(c), dtype=bool)
        first[begin[:-1]] = True
        starts = pretoken_starts(c, self.cls[c], first)
        ends = np.concatenate((starts[1:], [len(c)]))
        h = self.hashes(c, starts, ends)
        keys, sample, inverse = np.unique(h, return_index=True, return_inverse=True)
        known = list(map(self.seen.get, keys.tolist()))
        new = [i for i, x in enumerate(known) if x is None]
        if new:
            at = sample[new]
            joined = c.astype("<u4").tobytes().decode("utf-32-le")
            strings = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            if len(self.seen) + len(new) > CACHE:
                self.seen.clear()
            fresh = list(map(self.pretoken, strings))
            self.seen.update(zip(keys[new].tolist(), fresh, strict=True))
            for i, ids in zip(new, fresh, strict=True):
                known[i] = ids
        size = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        where = np.concatenate(([0], np.cumsum(size)))[:-1]
        each = size[inverse]
        stop = np.cumsum(each)
        ids = flat[np.arange(stop[-1]) + np.repeat(where[inverse] - (stop - each), each)]
        # The number of ids before each text's first pretoken.
        cut = np.concatenate(([0], stop))[np.searchsorted(starts, begin)]
        for k, i in enumerate(easy):
            out[i] = ids[cut[k] : cut[k + 1]]
        return out

    def hashes(self, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        from chronofeat.llm.textnum import powers

        up, down = powers(len(c) + 1)
        total = np.concatenate((np.zeros(1, dtype=U), np.cumsum(self.point_codes()[c] * up[: len(c)])))
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))

    def point_codes(self) -> np.ndarray:
        if not hasattr(self, "codes"):
            self.codes = mix(np.arange(1, 0x181, dtype=U) * U(0x9E3779B97F4A7C15))
        return self.codes
