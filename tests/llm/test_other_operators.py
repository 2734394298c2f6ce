import math
import random
import time
from fractions import Fraction
from itertools import groupby

import numpy as np
import pytest

from kvstrata.llm.chat import BEGIN, END, TEXT, format_conversations, intersect, parse, read_back, render, tokenizer, unescape
from kvstrata.llm.components import connected_components
from kvstrata.llm.embedding_dedup import near_duplicates
from kvstrata.llm.html_extract import extract, main_text
from kvstrata.llm.memo import Memo
from kvstrata.llm.queries import tokenizer_file
from kvstrata.llm.sentencepiece_codec import CharMap, PieceModel, encode_documents
from kvstrata.llm.storage import Scratch
from kvstrata.llm.topk import ABSENT, MOST, Tree, laid_out, scaled, top_k
from tests.llm import brute
from tests.llm.brute import ArticleText, passing_nodes, path_nodes

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "a▁ b", "x▁▁ y ", "\n", "a\nb", "é日本𝄞 \u0000 z", "  lead", "trail  ", "\t tab", "<s> </s> <0x41>", " x", "😀" * 5]


def test_sentencepiece_matches_the_library(spark):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice([" ", " ", "a", "the", "▁", "\n", "é", "日", "😀", "  ", ".", "\t"]) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "long " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in encode_documents(df, path).collect():
        text = texts[r.doc_id] or ""
        ids = library.encode(text, add_eos=True)
        assert r.ids == ids and r.decoded == library.decode(ids)
        assert r.begins[0] == 0 and r.ends[-1] == len(text.encode()) and r.begins[1:] == r.ends[:-1], "pieces cover the text"
    assert encode_documents(df.limit(0), path).count() == 0


def test_sentencepiece_of_odd_rows(spark):
    rows = [(None, "no id", 1, "x"), (7, "twice", 2, "y"), (7, "twice", 2, "y"), (8, None, 3, "z"), (9, "日本" * 30000, 4, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, decoded string")
    got = encode_documents(df, tokenizer_file("piece_bpe_32k.model")).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), t or "") for i, t, _, _ in rows)
    assert {r.doc_id: len(r.ids) for r in got}[8] == 1


def test_memo_holds_few_bytes():
    asked = []
    memo = Memo(lambda c: asked.append(c) or list(map(ord, c)), most=100_000)
    for chunk in ["a", "b", "a", "x" * 1000, "x" * 1000, *map(str, range(10_000)), "a"]:
        assert memo[chunk] == np.array(list(map(ord, chunk)), "<u4").tobytes() and memo.held <= 100_000
    assert asked.count("x" * 1000) == 2 and "x" * 1000 not in memo and asked[:3] == ["a", "b", "x" * 1000] and len(memo) < 500


def test_decode_of_any_ids():
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    model, library = PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    some = [np.array([rng.choice([0, 1, 2, 3 + 0xE3, 3 + 0x81, 3 + 0x41, 3 + 0xFF, 29871, 300, 13, 3 + 0xF0]) for _ in range(rng.randrange(9))], np.int32) for _ in range(500)]
    assert model.decode(some) == [library.decode(x.tolist()) for x in some]


def darts(keys: dict[bytes, bytes]) -> bytes:
    """A compiled character map of a few keys: blocks of 256 units, one block a trie node."""
    strings, at = b"", {}
    for k, v in keys.items():
        at[k] = len(strings)
        strings += v + b"\0"
    nodes = sorted({k[:n] for k in keys for n in range(len(k) + 1)}, key=lambda p: (len(p), p))
    base = {p: 256 * (i + 1) for i, p in enumerate(nodes)}
    units = [0] * (256 * (len(nodes) + 2))
    units[0] = (base[b""] >> 8 << 10) | 512
    for p in nodes:
        for q in nodes:
            if len(q) == len(p) + 1 and q.startswith(p):
                place = base[p] ^ q[-1]
                units[place] = ((place ^ base[q]) >> 8 << 10 | 512 if (place ^ base[q]) & 255 == 0 else (place ^ base[q]) << 10) | (256 if q in keys else 0) | q[-1]
                if q in keys:
                    units[base[q]] = 0x80000000 | at[q]
    return len(units * 4).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + strings


def test_longest_prefix_of_a_character_map():
    made = CharMap(darts({b"ab": b"X", b"abc": b"YY", "é".encode(): b"e", b"z": b""}))
    assert made.longest(b"abcd", 0) == (3, b"YY") and made.longest(b"abd", 0) == (2, b"X") and made.longest(b"ad", 0) is None
    assert made.longest("xé".encode(), 1) == (2, b"e") and made.longest(b"z", 0) == (1, b"")
    model = PieceModel(tokenizer_file("piece_bpe_32k.model"))
    model.char_map = made
    out, align = model.normalise("abc éz!")
    assert out == "▁YY▁e!".encode() and align.tolist() == [0, 0, 0, 0, 0, 3, 3, 3, 4, 7, 8]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    alphabet = ["\\", "<", END, "l", "\\l", "é", "😀", " ", "\n", "<turn>", "ab", "<|endoftext|>", "日本", "### Assistant: </turn>"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", None, "a<b"]), rng.choice([None, "".join(rng.choices(alphabet, k=rng.randrange(9)))])) for c in range(80) for t in range(rng.randrange(1, 6))]
    rows += [(None, 0, "assistant", "no id"), (5, None, "assistant", "first"), (5, 1, "user", "again"), (5, 1, "user", "again")]
    formatted = format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3), tokenizer_file("byte_bpe_50k.json"))
    bpe = tokenizer(tokenizer_file("byte_bpe_50k.json"))
    control = {bpe.token_to_id(x) for x in (BEGIN, TEXT, END)}
    for r in formatted.collect():
        assert len(r.ids) == len(r.mask) and not any(m and i in control for i, m in zip(r.ids, r.mask, strict=True))
        runs = [[i for i, _ in g] for m, g in groupby(zip(r.ids, r.mask, strict=True), key=lambda x: x[1]) if m]
        assert [unescape(bpe.decode(x)) for x in runs] == [x for role, x in parse(r.formatted) if role == "assistant" and x], "each run is one whole text"
        assert bpe.decode(r.ids, skip_special_tokens=False) == r.formatted
    back = {r.conv_id: r for r in read_back(formatted, tokenizer_file("byte_bpe_50k.json")).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t, role or "", text or "") for k, t, role, text in rows if k == c), key=lambda x: (x[0], x[1] or 0, *x[2:]))
        assert back[c].n_turns == len(turns) and back[c].turns == "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        assert back[c].loss_text == "".join(x for *_, r, x in turns if r == "assistant")
    assert format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").limit(0), tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_mask_is_by_intersections():
    text, spans, cuts = render([("user", "q"), ("assistant", "answer"), ("assistant", "")])
    assert cuts == [0]
    tokens = np.array([(k, min(k + 4, len(text))) for k in range(0, len(text), 4)])
    assert intersect(tokens, spans).tolist() == [any(max(a, x) < min(b, y) for x, y in spans) for a, b in tokens] and parse(text)[1] == ("assistant", "answer")
    assert intersect(np.zeros((0, 2), np.int64), spans).tolist() == [] and intersect(tokens, []).sum() == 0


def test_chat_in_pieces_has_the_same_tokens(spark):
    rng = random.Random(17)
    rows = [(1, k, rng.choice(["user", "assistant"]), "".join(rng.choices([" ", "word", "\n", "<", "é", "  ", "日", "."], k=rng.randrange(60)))) for k in range(4000)]
    r = format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), tokenizer_file("byte_bpe_50k.json")).first()
    e = tokenizer(tokenizer_file("byte_bpe_50k.json")).encode(r.formatted, add_special_tokens=False)
    text, spans, cuts = render([(role, t) for _, _, role, t in rows])
    assert len(cuts) > 2 and text == r.formatted and e.ids == r.ids and intersect(np.array(e.offsets), spans).tolist() == r.mask


def test_chat_of_odd_tables(spark):
    bpe = tokenizer_file("byte_bpe_50k.json")
    long = "long < text \\ " * 20000
    rows = [(1, 0, "user", "hi", 5, "x"), (1, 1, "assistant", long, 5, "y")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, ids int, formatted string")
    r = read_back(format_conversations(df, bpe), bpe).first()
    assert (r.n_turns, r.loss_text, r.turns) == (2, long, f"user\nhi\nassistant\n{long}\n")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, and more.</div><div class="ad">Buy now, it is cheap.</div>{0}<aside class="sidebar"><p>Other stories, many of them.</p></aside>
<form><label>Name</label><input></form><div id="comments"><p>A reader says, nice one. Really.</p></div><script>var x="</p>";</script><footer>&copy; 2020, all rights.</footer></body></html>"""


@pytest.mark.parametrize(
    "article, expected",
    [
        ("<article><h1>Head</h1><p>One  two,\n three.<p>Four&amp;five <b>bo</b>ld.</p></article>", "Head One two, three. Four&five bold."),
        ("<main><p>Only, this.</p><ul><li>a</li><li>b</li></ul></main>", "Only, this. a b"),
        ("<div class='c'><h2>Head</h2><p>Long text with words, and points. Many of them, here.</p><p>More of it, and more.</p></div>", "Head Long text with words, and points. Many of them, here. More of it, and more."),
        ("<article><p>a &lt; b &#233; <!-- no --> c<br>d</p></article>", "a < b é c d"),
    ],
)
def test_main_text(article, expected):
    assert main_text(PAGE.format(article)) == expected


BODY = "<p>Long text with words, and points. Many of them, here.</p><p>More of it, and more.</p>"
PLAIN = "Long text with words, and points. Many of them, here. More of it, and more."


@pytest.mark.parametrize("name", ["layout with-sidebar", "no-sidebar", "has-header", "widget", "comments"])
def test_html_hint_on_what_holds_the_article(name):
    assert main_text(f'<body><div class="{name}"><article>{BODY}</article></div><div class="ad">Buy, now.</div></body>') == PLAIN
    assert main_text(f'<body><div class="{name}"><div>{BODY}</div></div><div class="ad">Buy, now.</div></body>') == PLAIN


@pytest.mark.parametrize("mark", ['id="discussion"', 'id="legal-status"', 'id="search-algorithms"', 'class="share-price"'])
def test_html_hint_on_a_section_of_the_article(mark):
    assert main_text(f'<article><h1 {mark}>Head</h1>{BODY}<section {mark}>{BODY}</section></article>') == f"Head {PLAIN} {PLAIN}"
    page = f'<article>{BODY}{BODY}<div class="related-posts"><p>Other, too.</p></div><div id="comments"><p>Nice, really.</p></div></article>'
    assert main_text(page) == f"{PLAIN} {PLAIN}"


LONG = "Words of the text, and more of them; it goes on. " * 6


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<body><h1>Head</h1><div class=lead><p>{LONG}</p></div><div class=body>{f'<p>{LONG}</p>' * 6}</div></body>", "Head " + LONG * 7),
        (f"<body>{f'<article>{f"<p>{LONG}</p>" * 3}</article>'}<article>{f'<p>{LONG}</p>' * 2}</article></body>", LONG * 5),
        (f"<body><div><h1>Head</h1>{f'<p>{LONG}</p>' * 6}</div><article><p>{LONG[:150]}</p></article></body>", "Head " + LONG * 6 + LONG[:150]),
        (f"<main><h1>Head</h1><p>{LONG}</p><div itemprop=articleBody>{f'<p>{LONG}</p>' * 6}</div></main>", "Head " + LONG * 7),
        (f"<main><h1>Head</h1><p>By X</p><div itemprop=articleBody>{f'<p>{LONG}</p>' * 6}</div></main>", "Head By X " + LONG * 6),
        (f"<div><p>{LONG}</p>{f'<p>{LONG}</p>' * 6}<ul><li>a</li><li>b</li></ul></div>", LONG * 7 + "a b"),
    ],
)
def test_html_returns_all_content(page, expected):
    assert main_text(page) == expected.strip()


@pytest.mark.parametrize("mark", ['class="content has-sidebar"', 'class="layout-with-sidebar"', 'class="side-by-side"', 'class="search-results-page"', 'id="legal-article"', 'class="sidebar"'])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div>{}</div>", "{}"])
def test_html_wrapper_of_the_whole_page(mark, inner):
    assert main_text(f"<body><nav><a href=/>Home</a></nav><div {mark}>{inner.format(BODY)}</div><footer>2020</footer></body>") == PLAIN


def test_html_forms_and_own_headers():
    assert main_text(f'<form id="aspnetForm"><nav><a href=/>Home</a></nav><div>{BODY}</div><footer>2020</footer></form>') == PLAIN
    assert main_text(f"<body><div>{BODY}</div><form><label>Your name, please</label><p>Write to us.</p></form></body>") == PLAIN
    assert main_text(f'<div><div class="post-header"><h1>Head</h1></div>{BODY}</div>') == f"Head {PLAIN}"
    assert main_text(f"<header><h1>Site</h1></header><article><header><h1>Head</h1></header>{BODY}</article>") == f"Head {PLAIN}"


def test_html_odd_markup():
    assert main_text(f'{BODY}<p title="a > b, it">x, y.</p><a "b>c</a><p>d</p> <b') == f"{PLAIN} x, y. c d"
    assert main_text(f"<p class='unclosed>{LONG}</p><p>{LONG}</p>") == (LONG * 2).strip()
    assert main_text("<b>" * 3000 + LONG + "</i>" * 3000) == LONG.strip()
    for piece in ('<a "', "</p", "<a b='", '<a x="y\' ', "<!--", "<", '<a b=">"', "<p>", "<script>"):
        began = time.perf_counter()
        main_text(piece * 20000)
        assert time.perf_counter() - began < 5, piece


def test_html_ratios_are_those_of_the_definition():
    rng = random.Random(21)
    for _ in range(200):
        blocks = []
        for _ in range(rng.randrange(2, 9)):
            words = " ".join(rng.choice(["word", "and", "text,", "end.", "more;"]) for _ in range(rng.randrange(1, 40)))
            blocks.append(rng.choice(["<p>{}</p>", "<div><p>{}</p></div>", "<section><div>{}</div></section>", "<blockquote>{}</blockquote>"]).format(words))
        page = "<body>" + "".join(blocks) + "</body>"
        nodes = path_nodes(page.replace("<body>", "").replace("</body>", ""))
        passing = passing_nodes(nodes)
        got = main_text(page)
        at = 0
        for (_, text), yes in zip(nodes, passing, strict=True):
            if yes:
                at = got.index(text, at) + len(text)


def test_html_articles_of_the_pages_table(spark):
    found = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = {r.page_id: r.html for r in found.collect()}
    got = {r.page_id: r.text for r in extract(found).collect()}
    assert got == {i: ArticleText(h or "").text() for i, h in pages.items()} and len(got) > 200


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 7), (2, None, "", 7), (None, "u", "<p>x", 7), (4, "u", "plain < text", 7), (4, "u", "plain < text", 7), (5, "u", "<p>" + "word, " * 50000, 7)], "page_id bigint, url string, html string, text int")
    rows = extract(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == 6
    assert got[1] == "" and got[2] == "" and got[None] == "x" and got[4] == "plain < text" and len(got[5]) == 299999
    assert extract(df.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:60] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [float("nan")] * 16), (None, x[0].tolist()), (1100, [None] * 16), (1150, [math.inf] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in top_k(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    whole = np.floor(256 * x.astype(float)).astype(int)
    for q in range(0, 400, 50):
        best = sorted(((-int(whole[q] @ whole[c]), c) for c in range(400) if c != q))[:5]
        assert got[q] == {k + 1: (c, -s) for k, (s, c) in enumerate(best)}
    assert set(got) == set(range(0, 400, 50)) and top_k(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert top_k(few, few).count() == 6


def best_scores(rows, queries, k=5):
    """{query id: [(vec_id, score)]} in whole numbers of any size; different rows of one query id are one query."""
    out = {}
    for q in sorted({i for i, _ in queries}):
        asked = [v for i, v in queries if i == q]
        scores = [(-max(sum(floor256(a) * floor256(b) for a, b in zip(v, c, strict=False)) for v in asked), i) for i, c in rows if i != q]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def floor256(x: float) -> int:
    return math.floor(Fraction(x) * 256)


def found_scores(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return {q: [found[k] for k in sorted(found)] for q, found in got.items()}


def test_top_k_of_large_components(spark):
    rng = random.Random(14)
    rows = [(i, [rng.choice([0.5, 3e7 + 0.125, -3e7, float(1 << 41), -float(1 << 20), 0.0, 1e-300]) * rng.choice([1, 0.999]) for _ in range(3)]) for i in range(300)]
    rows = [(i, [math.fmod(x, 7.3) for x in v]) if i % 50 == 0 else (i, v) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert found_scores(top_k(df, df.where("vec_id % 50 = 0"))) == best_scores(rows, [r for r in rows if r[0] % 50 == 0])
    far = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1e300, 0.0]), (3, [-1e300, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="fit a bigint"):
        top_k(far, far.where("vec_id = 0")).collect()
    assert found_scores(top_k(far, far.where("vec_id = 0").limit(0))) == {}


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, -1.0]), (8, [2.0, 0.0]), (7, [1.5, 3.0]), (7, [1.5, 3.0]), (6, [1.0, 1.0]), (5, [0.1, 0.2])]
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], "vec_id bigint, embedding array<double>, score int, shard string").repartition(3)
    assert found_scores(top_k(df, df.where("vec_id % 50 = 0"))) == best_scores(rows, [r for r in rows if r[0] % 50 == 0])


def test_top_k_of_odd_lengths(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, []), (2, [4.0]), (3, [1.0, 1.0, 1.0, 50.0]), (50, [1.0, 1.0, 1.0, 1.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert found_scores(top_k(df, df.where("vec_id % 50 = 0"))) == best_scores(rows, [r for r in rows if r[0] % 50 == 0])
    empty = spark.createDataFrame([(0, []), (1, [])], "vec_id bigint, embedding array<double>")
    assert found_scores(top_k(empty, empty)) == {0: [(1, 0)], 1: [(0, 0)]}


def test_top_k_over_many_shards(spark, monkeypatch):
    import kvstrata.llm.topk as module

    monkeypatch.setattr(module, "SHARD_ROWS", 40)
    monkeypatch.setattr(module, "MET", (1, 3))
    test_top_k(spark)


def test_trees_open_few_nodes():
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(size=(2000, 3)), np.full((2000, 3), 9.0)])
    leaves = laid_out(scaled(x), 16)
    order = np.concatenate(leaves)
    tree = Tree(x[order], order, order, np.repeat(np.arange(len(leaves)), list(map(len, leaves))))
    assert len(tree.boxes.least_id) == 2 * len(leaves) - 1 and {len(r) for r in leaves} <= {15, 16}
    opened = []
    tree.scores = lambda *a, f=tree.scores: opened.append(a[-1]) or f(*a)
    s, i, _ = tree.search(x[:1], np.array([0]), 5, np.array([ABSENT]), np.array([MOST]))
    whole = np.floor(256 * x).astype(int)
    assert list(zip((-s[0]).tolist(), i[0].tolist(), strict=True)) == sorted((-int(whole[0] @ whole[c]), c) for c in range(1, 4000))[:5]
    assert len(opened) < len(leaves) / 8, "boxes and ids leave most leaves out, equal vectors too"


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for family in range(30):
        base = rng.normal(size=24)
        for _ in range(rng.integers(1, 12)):
            rows.append(((base + rng.normal(size=24) * rng.choice([0, 0.05, 0.2, 0.35])) * rng.choice([1, 3]), int(family % 3)))
    dense = rng.normal(size=24)
    rows += [(dense + rng.normal(size=24) * 0.03, 1) for _ in range(120)]
    rows = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [math.nan] * 24, 1), (903, rows[0][1], None), (904, [None] * 24, 0), (905, rows[0][1][:12], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], m) for i, v, m in rows]
    expected = brute.near_vectors(single)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df).collect()}
    found, wanted = sum(n for n, _ in got.values()), sum(n for n, _ in expected.values())
    assert got == expected, f"recall {found / wanted:.4f}"
    assert near_duplicates(df.limit(0)).count() == 0


def test_near_vectors_over_many_cells(spark, monkeypatch):
    import kvstrata.llm.embedding_dedup as module

    monkeypatch.setattr(module, "CELL_ROWS", 48)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 5)) @ rng.normal(size=(5, 384)) / math.sqrt(5) + 0.1 * rng.normal(size=(3000, 384))
    x = x.astype(np.float32)
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = (y @ y.T >= 0.93) & ~np.eye(3000, dtype=bool)
    expected = brute.components(list(range(3000)), list(zip(*map(np.ndarray.tolist, np.nonzero(links)), strict=True)))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df).collect()}
    recall = sum(n for n, _ in got.values()) / links.sum()
    assert got == {i: (int(links[i].sum()), expected[i]) for i in range(3000)}, f"recall {recall:.4f}"


def test_near_vectors_of_repeated_ids(spark):
    rng = np.random.default_rng(9)
    spot = rng.normal(size=24)
    rows = [(i % 40, (spot + 0.03 * rng.normal(size=24)).tolist(), 1) for i in range(100)] + [(50 + i, rng.normal(size=24).tolist(), 1) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    own = [sum(i % 40 == k for i in range(100)) for k in range(40)]
    got = {r.vec_id: r.n_links for r in near_duplicates(df).collect()}
    assert got == {k: own[k] * (100 - own[k]) for k in range(40)} | {50 + i: 0 for i in range(20)}


def test_near_vectors_with_other_columns(spark):
    rows = [(1, [1.0, 0.0], 1, "a", 5), (2, [1.0, 0.01], 1, "b", 6), (None, [1.0, 0.0], 1, "c", 7), (3, [0.0, 1.0], 1, "d", 8), (4, [1.0, 0.0], 2, "e", 9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, cell string, id int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, True), 3: (0, 3, True), 4: (0, 4, True)}


def test_components(spark, out):
    rng = random.Random(6)
    ids = list(range(200))
    links = [(rng.choice(ids), rng.choice(ids)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "u bigint, v bigint"), Scratch(spark, "test")).collect()}
    expected = brute.components([*ids, *range(300, 341)], links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: expected[i] for i in linked}
