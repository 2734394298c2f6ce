"""Brute-force versions of the contracts, in plain Python."""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from html.parser import HTMLParser

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return [w for w in SPACE.split((text or "").encode()) if w]


def lowered(text: str | None) -> list[bytes]:
    return words(re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = lowered(text)
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_documents(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id: (set size, component)."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def without_repeats(docs: list[tuple[int, str | None]], size: int = 13) -> dict[int, tuple[int, int, bytes]]:
    """doc_id: (words, removed, kept words joined by a space)."""
    least: dict[tuple, int] = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
    return out


def near_vectors(rows: list[tuple[int, list[float] | None, int | None]], limit: float = 0.93) -> dict[int, tuple[int, int]]:
    import numpy as np

    fine = [(i, np.array(v, float), label) for i, v, label in rows if v is not None and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for k, (a, x, m) in enumerate(fine) for b, y, n in fine[k + 1 :] if m == n and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= limit]
    count: dict[int, int] = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    found = components([i for i, *_ in rows], links)
    return {i: (count[i], found[i]) for i, *_ in rows}


def check_pieces(rows, ids_of: dict[int, bytes], longest: int = 2048) -> int:
    """Holds packed pieces against the documents' ids; gives the padding."""
    at: dict[int, int] = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids_of[r.doc_id]) // 4
        assert r.ids_crc32 == zlib.crc32(ids_of[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
        at[r.doc_id] += r.length
    assert {i: n for i, n in at.items()} == {i: len(b) // 4 for i, b in ids_of.items()}
    fill: dict[int, int] = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert all(n <= longest for n in fill.values())
    return sum(0 if n & (n - 1) == 0 else longest - n for n in fill.values())


class PlainMixture:
    """Languages of a text by EM over its words, each the product of its trigrams' frequencies."""

    def __init__(self, labelled: list[tuple[str, str]], bits: int = 15, smoothing: float = 0.5):
        self.bits, counts = bits, defaultdict(lambda: defaultdict(int))
        for text, lang in labelled:
            for word in self.words(text):
                for gram in word:
                    counts[lang][gram] += 1
        self.langs = sorted(counts)
        self.log = {}
        for lang in self.langs:
            total = sum(counts[lang].values()) + smoothing * 2**bits
            self.log[lang] = lambda gram, c=counts[lang], total=total: math.log((c.get(gram, 0) + smoothing) / total)

    def words(self, text: str) -> list[list[int]]:
        """Hashed trigrams about each letter byte, by runs of letter bytes."""
        data = bytearray(text.encode())
        for k in range(1, len(data)):
            if data[k - 1] == 0xC3 and 0x80 <= data[k] <= 0x9E and data[k] != 0x97:
                data[k] += 32
        folded = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in data]
        out, run = [], []
        for k, b in enumerate(folded):
            if b == 32:
                out, run = [*out, run], []
                continue
            left, right = folded[k - 1] if k else 32, folded[k + 1] if k + 1 < len(folded) else 32
            code = left << 16 | b << 8 | right
            run.append((code * 2654435761 & 0xFFFFFFFF) >> (32 - self.bits))
        return [w for w in [*out, run] if w]

    def shares(self, text: str) -> dict[str, float]:
        like = [{lang: sum(map(self.log[lang], w)) for lang in self.langs} for w in self.words(text)]
        rel = [{lang: math.exp(x[lang] - max(x.values())) for lang in self.langs} for x in like]

        def em(share: dict[str, float], rounds: int) -> dict[str, float]:
            for _ in range(rounds):
                total = dict.fromkeys(share, 0.0)
                for r in rel:
                    norm = max(sum(r[k] * share[k] for k in share), 1e-30)
                    for k in share:
                        total[k] += r[k] * share[k] / norm
                share = {k: x / len(rel) for k, x in total.items()}
            return share

        first = em({k: 1 / len(self.langs) for k in self.langs}, 12)
        order = sorted(self.langs, key=lambda k: -first[k])
        best = (-math.inf, {})
        for size in range(1, len(order) + 1):
            some = {k: max(first[k], 1e-3) for k in order[:size]}
            some = {k: x / sum(some.values()) for k, x in some.items()}
            if size > 1:
                some = em(some, 6)
            value = sum(math.log(max(sum(r[k] * some[k] for k in some), 1e-30)) for r in rel) - 0.5 * size * math.log(len(rel) + 1)
            if value > best[0]:
                best = value, some
        return {k: best[1].get(k, 0.0) for k in self.langs}


class ArticleText(HTMLParser):
    """Text of the article elements of a page, blocks joined by one space, by the standard library's parser."""

    BREAKS = frozenset("article p br h1 h2 h3 ul ol li div blockquote".split())

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in self.BREAKS:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.parts.append(" ")
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def path_nodes(page: str) -> list[tuple[str, str]]:
    """(tag path, text) of a well-formed page of block elements, by the standard library's parser."""
    found, stack = [], ["html"]

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            stack.append(tag)

        def handle_endtag(self, tag):
            stack.pop()

        def handle_data(self, data):
            if data.strip():
                found.append(("/".join(stack), data))

    Reader().feed(page)
    return found


def passing_nodes(nodes: list[tuple[str, str]]) -> list[bool]:
    """Which nodes' smoothed tag-path ratio reaches half of the page's mean, written down from the definition."""
    length = [len("".join(t.split())) for _, t in nodes]
    marks = [sum(t.count(c) for c in ".,;:!?") for _, t in nodes]

    def ratio(path: str) -> float:
        mine = [k for k, (p, _) in enumerate(nodes) if p == path]
        return sum(length[k] for k in mine) / len(mine) * (0.1 + sum(marks[k] for k in mine) / len(mine))

    plain = [ratio(p) for p, _ in nodes]
    smooth = []
    for k in range(len(nodes)):
        around = [plain[i] for i in (k - 1, k, k + 1) if 0 <= i < len(nodes)]
        smooth.append((plain[k] + sum(around)) / (1 + len(around)))
    return [x >= sum(smooth) / len(smooth) / 2 for x in smooth]
