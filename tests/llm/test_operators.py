"""Each operator against a brute-force version, an exact round trip, or held-out accuracy, and on odd input."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rooftide.llm import bpe, common, ctw, html_extract, jpeg, langid, mixing, neardup, queries, shard, topk, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, h int, size string"
ODD = [None, "", " \t\n", "a", "the cat", "!!!", "the cat sat on the mat " * 4000, "the cat sat on the mat", "the cat sat on the mat", "éÉ ß İ Σ 你好", "x" * 5000]


def docs(spark: SparkSession, texts: list, ids: list | None = None, sources: list | None = None):
    ids, sources = ids or list(range(len(texts))), sources or ["a"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, 1, "clash", 7, "clash") for i, t, s in zip(ids, texts, sources, strict=True)], DOCS)


def odd(spark: SparkSession):
    """Odd texts, a null id, a repeated row, a null source, and columns whose names the operators use."""
    return docs(spark, [*ODD, "the cat", "a"], [*range(len(ODD)), None, 3], [None, *["b"] * (len(ODD) + 1)])


def reference_tokenizer() -> Tokenizer:
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark: SparkSession) -> None:
    texts = [*ODD, "a<|endoftext|>b", "don't I'LL", "ΑΣ ΣΑΣ", "\x1c a\x85b"]
    rows = bpe.decode(bpe.encode(docs(spark, texts), PATH), PATH).collect()
    t = reference_tokenizer()
    assert len(rows) == len(texts)
    for r in rows:
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert bytes(r.decoded) == t.decode(ids, skip_special_tokens=False).encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=list("abcdeXYZ  '.,!<|>/éÉİΣẞ你१½\t\n\x1c\xa0'stll019_-"), max_size=60))
def test_bpe_on_any_text(text: str) -> None:
    ids = np.frombuffer(word_bpe_cached().encode_batch([text])[0], "<u4").tolist()
    assert ids == reference_cached().encode(text, add_special_tokens=False).ids


def reference_cached(found: list = []) -> Tokenizer:  # noqa: B006
    found.append(found[0] if found else reference_tokenizer())
    return found[0]


def word_bpe_cached(found: list = []) -> bpe.WordBpe:  # noqa: B006
    found.append(found[0] if found else bpe.WordBpe(bpe.read_spec(PATH)))
    return found[0]


def test_bpe_verifies_what_it_speculates() -> None:
    b = bpe.WordBpe(bpe.read_spec(PATH))
    b.encode_batch(["thnterble atst onthtionhent erth reeant blest ndwhst"])
    assert b.merged > 0 and b.pairs.size > 0 and not b.holds.all()


def test_bpe_takes_very_long_words_whole() -> None:
    rng, b, t = random.Random(3), word_bpe_cached(), reference_tokenizer()
    for n in (bpe.SCAN, bpe.SCAN + 1, 300, 20_000):
        for letters in ("abcdefghijklmnop", "aab", "é"):
            word = "".join(rng.choices(letters, k=n))
            assert np.frombuffer(b.encode_batch([word])[0], "<u4").tolist() == t.encode(word, add_special_tokens=False).ids
    start = time.perf_counter()
    b.encode_batch(["".join(rng.choices("abcdefghijklmnop", k=200_000))])
    assert time.perf_counter() - start < 20


def test_bpe_memory_is_bounded(monkeypatch: pytest.MonkeyPatch) -> None:
    b = bpe.WordBpe(bpe.read_spec(PATH))
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    for i in range(20):
        b.encode_batch([" ".join(f"w{i}x{k}" for k in range(50))])
    assert b.held <= 40_000 and len(b.known) < 150


def test_bpe_remembers_what_it_meets_again(monkeypatch: pytest.MonkeyPatch) -> None:
    """A full memory forgets rare words; frequent ones are not learned anew each time, and ids stay those of the library."""
    b, learned = bpe.WordBpe(bpe.read_spec(PATH)), Counter()
    monkeypatch.setattr(bpe, "CACHE_BYTES", 40_000)
    learn = b.learn
    monkeypatch.setattr(b, "learn", lambda chunks: (learned.update(chunks), learn(chunks)))
    for i in range(30):
        text = "the cat sat " + " ".join(f"w{i}x{k}" for k in range(50))
        assert np.frombuffer(b.encode_batch([text])[0], "<u4").tolist() == reference_cached().encode(text, add_special_tokens=False).ids
    assert {learned[w] for w in ("the", "cat", "sat")} == {1} and b.held <= 80_000 and len(b.known) < 200


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def own_text(source: str) -> str:
    """The main text of a page that is the only one of its host."""
    read = html_extract.read(source)
    tree = html_extract.place(read)
    return html_extract.main_text(read, html_extract.Site(1, frozenset(x for x in [*tree.nodes, *tree.leaves] if x & 1), {}, {}))


def test_html_keeps_the_article_only() -> None:
    body = (
        "<nav><ul><li><a href=/>Home</a></li></ul></nav><!-- x --><div class='cookie-notice'>We use</div><div class=ad>Buy</div>"
        "<article><h1>Ti&amp;tle</h1><p><b>One<br>  two.<p>Thr<i>ee</i></p><form>f</form><section class=comments><p>reader</p></section></article>"
        "<aside>side</aside><footer>&copy; x</footer>"
    )
    assert own_text(page(body)) == "Ti&tle One two. Three"
    assert own_text(page("<p>a</p><div>b c</div>")) == "a b c"
    assert own_text("<p>cut <b>off") == "cut off"
    assert own_text("<!-- never closed <p>x") == ""


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "with-comments", "content-sidebar-wrap", "ad-free", "site-header-fixed"])
def test_html_keeps_what_a_named_wrapper_holds(name: str) -> None:
    side = "<div class=sidebar><article>Teaser</article></div><div class=comments><p>A reader who writes more than the article does</p></div>"
    text = lambda body: own_text(page(body))
    assert text(f"<div class='{name}'><article><p>The story</p></article>{side}</div>") == "The story"
    assert text(f"<main><h1>Title</h1><div class='{name}'><p>The story of the day</p></div><div class=share>Share</div></main>") == "Title The story of the day"
    assert text(f"<div id='{name}'><p>The story of the day</p><div class=promo>Buy</div></div>") == "The story of the day"
    assert text(f"<article><p>The story</p></article><div class='{name}'><article>Teaser</article></div>") == "The story"


def test_html_silent_elements_and_names() -> None:
    assert own_text("<p>a<svg><svg><text>in</text></svg><text>label</text></svg>b</p>") == "ab"
    assert own_text("<button>open<p>rest of page</p>") == "rest of page"
    assert own_text("<div><button>x</div><p>stays</p><button>y</button>") == "stays"
    for name in ("class='story social-housing'", "class=widget-text", "id=notice-of-death"):
        assert own_text(f"<article><h1>T</h1><div {name}><p>All that is told here</p></div></article>") == "T All that is told here"
    assert own_text("<div>" * 9000 + "x" + "</div>" * 9000) == "x"
    start = time.perf_counter()
    html_extract.page_features(html_extract.read("<div class=a>y" * 8000))
    assert time.perf_counter() - start < 2


def importance_by_force(htmls: list[str]) -> dict[int, float]:
    """Entropies of one host's nodes, straight from the definition."""
    seen, styles, texts = Counter(), defaultdict(Counter), defaultdict(Counter)
    for source in htmls:
        for node, kind, feature in html_extract.page_features(html_extract.read(source)):
            if node and kind == "page":
                seen[node] += 1
            elif node:
                (styles if kind == "style" else texts)[node][feature] += 1
    out = {}
    for node, m in seen.items():
        entropy = lambda c, m=m: -sum(n / c.total() * math.log(n / c.total()) for n in c.values()) / math.log(m) if c else 0.0
        own = (1 - html_extract.GAMMA) * entropy(styles[node]) + html_extract.GAMMA * entropy(texts[node]) if m > 1 else 1.0
        out[node] = (m * own + html_extract.DOUBT) / (m + html_extract.DOUBT) * (html_extract.MARKED if node & 1 else 1)
    return out


def test_style_tree_drops_what_a_host_repeats(spark: SparkSession) -> None:
    one = lambda i: page(f"<nav>{i}</nav><div class=box><p>Same line on all pages</p></div><div class=story><p>Story {i} {'w' * i}</p>{'<p>x</p>' * (i % 3)}<p>More of {i}</p></div>")
    rows = [(i, f"https://a.example/{i}", one(i)) for i in range(30)] + [(100, None, None), (101, "odd", ""), (None, "https://b.example/", page("<p>lone</p>"))]
    rows += [(102, "https://c.example/", one(1)), (102, "https://c.example/", one(1))]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, site string")
    for size in (8 << 20, 0):  # broadcast and joined
        found = {r.page_id: r.text for r in html_extract.extract(table, broadcast_bytes=size).collect()}
        assert found[3] == "Story 3 www More of 3" and found[100] == "" and found[101] == "" and found[None] == "lone"
        assert found[102] == "Same line on all pages Story 1 w x More of 1"
    tree = {r.node: r.importance for r in html_extract.style_tree(table).where("host = 'a.example'").collect()}
    want = importance_by_force([one(i) for i in range(30)])
    assert tree.keys() == want.keys() and all(tree[k] == pytest.approx(want[k]) for k in want)
    read = html_extract.read(one(4))
    named = dict(zip(read.label, html_extract.place(read).nodes, strict=True))
    assert tree[named["div.box"]] < html_extract.LEAST < tree[named["div.story"]] and tree[named["nav"]] < html_extract.LEAST
    assert html_extract.extract(table.limit(0)).count() == 0


def test_the_tree_decides_pages_of_the_tables(spark: SparkSession) -> None:
    path = Path("/root/testdata/sf0.01/pages.parquet")
    if not path.exists():
        pytest.skip("no tables here")
    table = spark.read.parquet(str(path))
    with_tree = {r.page_id: r.text for r in html_extract.extract(table).collect()}
    changed = sum(html_extract.main_text(html_extract.read(r.html or ""), None) != with_tree[r.page_id] for r in table.collect())
    assert changed > len(with_tree) / 2


def test_style_tree_judges_articles_and_small_hosts(spark: SparkSession) -> None:
    story = lambda i: f"<p>Story {i} {'w' * (i + 1)} of the day</p><p>More of {i} with other words</p>"
    one = lambda i: page(f"<article>{story(i)}<p>Follow us</p><div class=box><p>Texts under a licence</p></div></article>")
    rows = [(i, f"https://a.example/{i}", one(min(i, 20))) for i in range(30)]  # one article is published ten times
    rows += [(100 + i, f"https://b.example/{i}", page(f"<main>{story(i)}<p>Follow us</p></main>")) for i in range(3)]
    rows += [(200 + i, f"https://c.example/{i}", page(f"<main>{story(7)}</main>")) for i in range(9)]
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda i: f"Story {i} {'w' * (i + 1)} of the day More of {i} with other words"
    assert [found[i] for i in range(30)] == [text(min(i, 20)) for i in range(30)]
    assert [found[100 + i] for i in range(3)] == [text(i) for i in range(3)]
    assert [found[200 + i] for i in range(9)] == [text(7)] * 9


def test_warc_round_trip_and_audit(spark: SparkSession) -> None:
    rows = [(i, f"https://a.example/{i}", "é" * (i % 50) * 40) for i in range(3000)] + [(None, None, None)]
    records = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()
    listed = records.where("archive = 1").orderBy("offset").collect()
    data = b"".join(bytes(r.content) for r in listed)
    parsed = list(warc.parse(data))
    assert [p[0] for p in parsed] == [r.offset for r in listed] and parsed[5][3].decode() == rows[1029][2]
    other = records.where(~F.coalesce(F.col("page_id").isin(7, 2500), F.lit(False))).withColumn("content", F.when(F.col("page_id") == 1500, F.lit(b"?")).otherwise(F.col("content")))
    found = warc.audit(warc.leaves(records), warc.leaves(other)).join(records, ["archive", "offset"]).select("page_id", "verdict").collect()
    assert {(r.page_id, r.verdict) for r in found} == {(7, "missing"), (2500, "missing"), (1500, "changed")}
    assert warc.audit(warc.leaves(records), warc.leaves(records)).count() == 0
    digests = [hashlib.sha256(bytes(r.content)).hexdigest() for r in listed]
    by_range = defaultdict(list)
    for r, d in zip(listed, digests, strict=True):
        by_range[r.offset >> 16].append(d)
    level = {k: hashlib.sha256("".join(v).encode()).hexdigest() for k, v in by_range.items()}
    for _ in range(2):
        up = defaultdict(list)
        for k in sorted(level):
            up[k >> 4].append(level[k])
        level = {k: hashlib.sha256("".join(v).encode()).hexdigest() for k, v in up.items()}
    root = hashlib.sha256("".join(level[k] for k in sorted(level)).encode()).hexdigest()
    assert warc.roots(warc.nodes(warc.leaves(records))).where("archive = 1").first().root == root
    table = spark.createDataFrame([(*r, "clash", 1, 2) for r in [*rows, rows[3], (None, "u", "x")]], "page_id long, url string, html string, content string, offset int, archive int")
    both = [{(r.archive, r.offset, r.page_id, r.length, r.digest) for r in x.collect()} for x in (warc.inventory(table), warc.archive(table).select("page_id", "archive", "offset", F.octet_length("content").alias("length"), F.sha2("content", 256).alias("digest")))]
    assert both[0] == both[1] and len(both[0]) == 3003 and {r[0] for r in both[0] if r[2] is None} != {-1}
    assert warc.inventory(table.limit(0)).count() == 0 and warc.audit(warc.leaves(records.limit(0)), warc.leaves(records.limit(0))).count() == 0


def test_warc_files_are_scanned(spark: SparkSession, tmp_path) -> None:
    import gzip

    rows = [(i, f"https://a.example/{i}", "é" * i) for i in range(40)]
    listed = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("offset").collect()
    parts = [bytes(r.content) for r in listed]
    (tmp_path / "plain.warc").write_bytes(b"".join(parts))
    (tmp_path / "records.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    (tmp_path / "empty.warc").write_bytes(b"")
    found = defaultdict(list)
    for r in warc.scan(spark.read.format("binaryFile").load(str(tmp_path))).collect():
        found[Path(r.archive).name].append(r)
    assert set(found) == {"plain.warc", "records.warc.gz", "whole.warc.gz"}
    for name, got in found.items():
        got.sort(key=lambda r: r.offset)
        assert [bytes(r.content) for r in got] == parts and [r.url for r in got] == [r[1] for r in rows], name
    assert [r.offset for r in found["plain.warc"]] == [r.offset for r in listed] and found["plain.warc"][0].time.year == 2024
    sizes = [len(gzip.compress(p)) for p in parts]
    assert [(r.offset, r.length) for r in found["records.warc.gz"]] == [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(gzip.compress(parts[0])[:-9]))


def test_top_k_is_exact(spark: SparkSession) -> None:
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 8)), 3)
    x[40:90] = x[40]  # ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(700, None, 1), (701, [1.0, None], 1), (702, [float("nan")], 1), (703, [float("inf")], 1), (None, [1.0], 1), (40, x[40].tolist(), 2), (704, [0.5], 1)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), F.col("id") % 20 == 0).collect()
    q = {i: np.floor(64 * v).astype(int) for i, v in enumerate(x)} | {704: np.array([32] + [0] * 7)}
    by = defaultdict(list)
    for r in found:
        by[r.query_id].append((r["rank"], r.id, r.score))
    assert sorted(by) == [i for i in range(600) if i % 20 == 0]
    for i, got in by.items():
        best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:20]
        assert [(n, j, s) for n, j, s in sorted(got)] == [(n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).count() == 0


def test_pivots_rule_candidates_out() -> None:
    rng = np.random.default_rng(5)
    far = np.floor(rng.normal(size=(4000, 16)) * 20)
    near = np.floor(rng.normal(size=(30, 16)) * 2 + 300)
    c = np.concatenate([far, near])
    pivots = topk.choose_pivots(c[::40])
    far_q, far_c = topk.distances(near[:1], pivots), topk.distances(c, pivots)
    *_, evaluated = topk.search(np.array([-1]), near[:1], far_q, np.arange(len(c)), c, far_c, 20)
    assert evaluated < len(c) / 4
    *_, least, _ = topk.search(np.array([-1]), near[:1], far_q, np.arange(len(c)), c, far_c, 20)
    *_, fewer = topk.search(np.array([-1]), near[:1], far_q, np.arange(100), c[:100], far_c[:100], 20, np.array([float(least[0][-1])]))
    assert fewer == 0  # nothing in that block can reach the score that another one gave


@pytest.mark.parametrize("size", [1.0, 4.0e6, 2.0**40])
def test_top_k_of_large_components(spark: SparkSession, size: float, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(150, 3)) * size if size < 2.0**40 else rng.integers(-9, 9, size=(150, 3)) * 2.0**20, 3)
    found = topk.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("id") % 10 == 0, k=7).collect()
    q = [[math.floor(64 * c) for c in v] for v in x]
    for i in range(0, 150, 10):
        want = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in range(150) if j != i)[:7]
        assert sorted((r["rank"], r.id, r.score) for r in found if r.query_id == i) == [(n, j, -s) for n, (s, j) in enumerate(want, 1)]


def test_top_k_sends_queries_to_reached_blocks_only(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Clusters: few pairs of query and block are left, ties over blocks are kept, and the result is exact."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    monkeypatch.setattr(topk, "BOUND_BOXES", 7)
    monkeypatch.setattr(topk, "BOUND_QUERIES", 30)
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(20, 6))
    middles *= 40 / np.linalg.norm(middles, axis=1)[:, None]
    x = np.repeat(middles, 60, 0) + rng.normal(size=(1200, 6)) / 8
    x[::60] = x[0]  # equal vectors, more than a block holds with their cluster
    sent = []
    plain = topk.reached

    def counted(asked: DataFrame, box: DataFrame, *rest: int) -> DataFrame:
        sent.append((asked.count(), box.select("home").distinct().count(), plain(asked, box, *rest).count()))
        return plain(asked, box, *rest)

    monkeypatch.setattr(topk, "reached", counted)
    found = topk.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("id") % 10 == 0, k=9).collect()
    (queries_, blocks, pairs), = sent
    assert queries_ == 120 and blocks >= 20 and pairs < queries_ * blocks / 4
    q = np.floor(64 * x).astype(int)
    by = defaultdict(list)
    for r in found:
        by[r.query_id].append((r["rank"], r.id, r.score))
    for i in range(0, 1200, 10):
        best = sorted((-int(s), j) for j, s in enumerate(q @ q[i]) if j != i)[:9]
        assert sorted(by[i]) == [(n, j, -s) for n, (s, j) in enumerate(best, 1)]


def test_far_pivots_rule_out_no_best_candidate() -> None:
    """A pivot much farther than the vectors are long is tabled with rounding, which bounds allow for."""
    rng = np.random.default_rng(13)
    c = np.floor(rng.normal(size=(3000, 4)) * 40)
    pivots = np.floor(rng.normal(size=(6, 4)) * 1e9)
    far = topk.distances(c, pivots)
    q, s = c[:40], c @ c[:40].T
    np.fill_diagonal(s[:40], -np.inf)
    ids = np.arange(len(c))
    _, got, scores, _ = topk.search(ids[:40], q, far[:40], ids, c, far, 5)
    for i in range(40):
        want = np.lexsort((ids, -s[:, i]))[:5]
        assert got[i].tolist() == want.tolist() and scores[i].tolist() == s[want, i].tolist()
        assert (topk.box_bounds(far[i], (q[i] ** 2).sum(), far[:1], far[:1], (c[:1] ** 2).sum(1)) >= c[0] @ q[i]).all()
        box = topk.box_bounds(far[i], (q[i] ** 2).sum(), far.min(0)[None], far.max(0)[None], (c * c).sum(1).max()[None])
        assert box[0] >= s[:, i].max()


def water_filling(sizes: list[int], weights: list[float], words: float) -> list[float]:
    """Clamp and reshare until nothing is above its cap."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest = words - sum(target[i] for i in range(len(sizes)) if i not in open_)
        over = {i for i in open_ if rest * weights[i] / sum(weights[j] for j in open_) > 2 * sizes[i]}
        if not over:
            for i in open_:
                target[i] = rest * weights[i] / sum(weights[j] for j in open_)
            break
        for i in over:
            target[i] = 2.0 * sizes[i]
        open_ -= over
    return target


def test_mixing_fills_to_the_targets(spark: SparkSession) -> None:
    rng = random.Random(4)
    sources = [rng.choice(["a", "b", "c", "ä", None]) for _ in range(3000)]
    sizes = [rng.randint(0, 60) * (9 if s == "b" else 1) for s in sources]
    table = docs(spark, [" ".join(["w"] * n) if n else None for n in sizes], None, sources)
    rows = mixing.mix(table).collect()
    assert len(rows) == 3000 and sorted(map(tuple, rows), key=lambda r: r[0]) == sorted(map(tuple, mixing.mix(table.repartition(7)).collect()), key=lambda r: r[0])
    order = ["a", "b", "c", "ä", None]
    totals = [sum(n for n, s in zip(sizes, sources, strict=True) if s == k) for k in order]
    want = water_filling(totals, [3, 1, 2, 3, 1], 1.5 * sum(totals))
    for k, total, target in zip(order, totals, want, strict=True):
        own = [r for r in rows if r.source == k]
        assert own[0].source_size == total and own[0].target == pytest.approx(target)
        assert abs(sum(r["size"] * r.repeats for r in own) - target) <= max(r["size"] for r in own)
        assert all(0 <= r.repeats <= 2 for r in own)
    assert mixing.repeated(mixing.mix(table)).count() == sum(r.repeats for r in rows)
    assert mixing.mix(docs(spark, ["a"]).limit(0)).count() == 0
    assert mixing.mix(docs(spark, [None, ""])).select("target").distinct().collect()[0][0] == 0


def test_language_of_held_out_text(spark: SparkSession) -> None:
    rng = random.Random(2)
    parts = {"en": ["the", "and", "ing", "tion", "wh"], "de": ["der", "und", "sch", "ung", "ich"]}
    one = lambda k: " ".join("".join(rng.choices(parts[k], k=rng.randint(1, 3))) for _ in range(30))
    rows = [(i, one("en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(400)]
    model = langid.fit(spark.createDataFrame(rows[:300], "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    found = langid.predict(spark.createDataFrame(rows[300:], "doc_id long, text string, lang string"), model).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") and 0 <= r.score <= 1 for r in found)
    assert (model.words.find(langid.hashed(["schschtionund"])) < 0).all()
    odd_rows = {r.doc_id: r for r in langid.predict(odd(spark), model).collect() if r.doc_id is not None}
    assert [odd_rows[i].lang_pred for i in (0, 1, 2, 5)] == ["und"] * 4 and odd_rows[0].score == 0
    empty = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.predict(odd(spark), empty).collect()} == {"und"}


@pytest.mark.parametrize("few", [1, 4, 20])
def test_a_small_language_is_learned_and_swallows_none(spark: SparkSession, few: int) -> None:
    rng = random.Random(11)
    stems = {k: ["".join(rng.choices(letters, k=rng.randint(2, 4))) for _ in range(60)] for k, letters in {"de": "aeschrtu", "en": "aeothnwi", "es": "aeolsrdq"}.items()}
    one = lambda k: " ".join("".join(rng.choices(stems[k], k=rng.randint(1, 2))) for _ in range(30))
    sizes = {"de": 1500, "en": 1500, "es": few}
    rows = [(i, one(k), k) for k, n in sizes.items() for i in range(n)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_documents=1000)
    tests = [(i, one(k), k) for k in sizes for i in range(100)]
    found = list(zip((k for *_, k in tests), langid.Predictor(model)([t for _, t, _ in tests])[0], strict=True))
    assert model.languages == ["de", "en", "es"]
    right = Counter(k for k, got in found if k == got)
    assert right["de"] >= 97 and right["en"] >= 97 and right["es"] >= 80


def language_by_force(rows: list[tuple], text: str | None) -> tuple[str, float]:
    """Word-first backoff from plain counts."""
    words, grams, names = defaultdict(Counter), defaultdict(Counter), sorted({k for _, k in rows})
    for t, k in rows:
        for w in langid.LETTERS.findall((t or "").lower()):
            words[k][w] += 1
            for n in langid.SIZES:
                for g in langid.grams(w, n):
                    grams[k, n][g] += 1
    found = langid.LETTERS.findall((text or "").lower())
    if not found or not names:
        return "und", 0.0

    def log(tables: list[Counter], key: str) -> list[float] | None:
        if not any(key in t for t in tables):
            return None
        size = len(set().union(*tables))
        return [math.log((1 - langid.UNIFORM) * t[key] / max(t.total(), 1) + langid.UNIFORM / size) for t in tables]

    sums = [0.0] * len(names)
    for w in found:
        own = log([words[k] for k in names], w)
        if own is None:
            marked, parts = f"^{w}$", []
            for i in range(len(marked)):
                hit = next((x for n in langid.SIZES if i + n <= len(marked) and (x := log([grams[k, n] for k in names], marked[i : i + n]))), None)
                parts += [hit] if hit else []
            own = [sum(x) / len(parts) for x in zip(*parts, strict=True)] if parts else [0.0] * len(names)
        sums = [a + b for a, b in zip(sums, own, strict=True)]
    best = max(range(len(names)), key=lambda i: (sums[i], -i))
    return names[best], 1 / sum(math.exp(x - sums[best]) for x in sums)


def test_language_by_force(spark: SparkSession) -> None:
    rng = random.Random(21)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(rng.randint(1, 9)))
    rows = [(make(x), k) for k, x in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "abcde")) for _ in range(12)] + [(None, "dd"), ("12 !", "dd"), ("abc", None)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    texts = [make("abcdefgh") for _ in range(60)] + ["zzz", "a", "x" * 3000, *[t for t in ODD if t is None or len(t) < 2000], rows[0][0]]
    found = langid.predict(docs(spark, texts), model, keep=("text", "size")).collect()
    learned = [(t, k) for t, k in rows if t is not None and k is not None and langid.LETTERS.search(t)]
    for r in found:
        name, share = language_by_force(learned, texts[r.doc_id])
        assert (r.lang_pred, r.kept_text, r.kept_size) == (name, texts[r.doc_id], "clash") and r.score == pytest.approx(share, abs=1e-9)


def test_equal_languages_tie_by_name(spark: SparkSession) -> None:
    model = langid.fit(spark.createDataFrame([("ab cd", "y"), ("ab cd", "x")], "text string, lang string"))
    assert langid.Predictor(model)(["ab", "cd zz", "ab"]) == (["x"] * 3, [0.5] * 3)


def test_fair_share_and_sample(spark: SparkSession) -> None:
    assert [langid.fair_share(x, 100) for x in ([], [5], [5, 1000], [5, 1000, 2000], [200] * 300)] == [0, 5, 95, 47, 1]
    rows = [(i, "same text", "en") for i in range(900)] + [(i, f"text {i}", "de") for i in range(900)] + [(1, "texto", "es")]
    got = Counter(r.lang for r in langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", 301).collect())
    assert got["es"] == 1 and 100 < got["en"] < 200 and 100 < got["de"] < 200


def groups_by_force(rows: list[tuple], words: int, percent: int) -> dict:
    sets = {}
    for i, t in rows:
        w = queries_words(t)
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def queries_words(text: str | None) -> list[str]:
    from rooftide.llm.common import LOWER_ASCII, WORDS

    return WORDS.findall((text or "").translate(LOWER_ASCII))


@pytest.mark.parametrize(("words", "percent", "block", "size", "deviations"), [(3, 85, 20, 1 << 20, 6.0), (5, 80, 2048, 4000, None), (3, 70, 2048, 1 << 20, 6.0), (2, 60, 30, 9000, 6.0), (3, 50, 2048, 1 << 20, None)])
def test_near_duplicates_lose_no_link(spark: SparkSession, words: int, percent: int, block: int, size: int, deviations: float | None, monkeypatch: pytest.MonkeyPatch) -> None:
    rng = random.Random(words)
    lexicon = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choices(lexicon, k=80) for _ in range(6)]
    for i in range(260):
        text = list(base[i % 6]) if i % 3 else rng.choices(lexicon, k=rng.randint(1, 60))
        for _ in range(rng.randint(0, 5) if i % 3 else 0):
            text[rng.randrange(len(text))] = rng.choice(lexicon)
        rows.append((i, " ".join(text)))
    rows += [(300, None), (301, ""), (302, "one"), (303, "One"), (304, "one two"), (305, " \n"), (306, rows[1][1].upper())]
    monkeypatch.setattr(neardup, "BLOCK", block)  # several blocks to a bucket, by members and by bytes
    monkeypatch.setattr(neardup, "BLOCK_BYTES", size)
    monkeypatch.setattr(neardup, "FILTER_SETS", 10 if words == 5 else 1000)
    found = neardup.groups(spark.createDataFrame([*rows, (None, "one")], "doc_id long, text string"), words, percent, deviations=deviations).collect()
    want = groups_by_force(rows, words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert len(found) == len(rows) + 1 and sum(r.component_id != r.doc_id for r in found) > 50


def test_near_duplicates_keep_texts_that_share_a_key(spark: SparkSession) -> None:
    long = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, long("a")), (1, long("b")), (2, long("a") + " x"), (3, long("b")), (3, long("b")), (4, long("c")), (4, long("c")), (None, long("a")), (5, None), (5, ""), (6, long("d")), ("7", None)]
    table = spark.createDataFrame([(str(i) if i is not None else None, t, "clash", 1) for i, t in rows], "doc_id string, text string, text_hash string, class int")
    found = Counter((r.doc_id, r.component_id) for r in neardup.groups(table).collect())
    assert found == {("1", "1"): 2, ("2", "1"): 1, ("3", "1"): 2, ("4", "4"): 2, (None, None): 1, ("5", "5"): 2, ("6", "6"): 1, ("7", "7"): 1}
    kept = Counter((r.doc_id, r.text, r.text_hash) for r in neardup.one_of_each(table).collect())
    want = [("1", long("a")), ("1", long("b")), ("4", long("c")), (None, long("a")), ("5", None), ("5", ""), ("6", long("d")), ("7", None)]
    assert kept == Counter((*x, "clash") for x in want)
    assert neardup.one_of_each(table.limit(0)).count() == 0 and neardup.groups(table.limit(0)).count() == 0


def test_bands_miss_few_pairs_at_any_threshold() -> None:
    for percent in range(10, 100):
        r, t = neardup.rows_per_band(percent / 100), percent / 100
        assert (1 - t**r) ** (neardup.REGISTERS // r) <= 3e-9
    with pytest.raises(ValueError, match="registers"):
        neardup.rows_per_band(0.05)


def test_registers_merge_and_estimate() -> None:
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (2000, 300))
    x, y = np.concatenate([a, b]), a
    assert (neardup.merge(neardup.registers(a), neardup.registers(b)) == neardup.registers(x)).all()
    p, q = neardup.registers(x).astype(int), neardup.registers(y).astype(int)
    got = neardup.estimate(*[np.array([v]) for v in ((p > q).sum(), (p < q).sum(), (p == q).sum())], np.array([len(x)]), np.array([len(y)]))[0]
    assert abs(got - len(y) / len(x)) < 0.08
    assert neardup.groups is not None


def test_jpeg_is_lossless(spark: SparkSession) -> None:
    rng = random.Random(8)
    blobs = [*[bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 63, 64, 65, 4096, 5000)], b"\xff" * 700, bytes(jpeg.ROW * (jpeg.FRAME_ROWS + 3))]
    padded = [jpeg.pad(b) for b in blobs]
    streams = jpeg.write(padded)
    ends = np.cumsum([len(s) for s in streams]).tolist()
    frames = jpeg.decode(b"".join(streams), [(e - len(s), e) for e, s in zip(ends, streams, strict=True)])
    assert [b"".join(f.luma.tobytes() for f in x) for x in frames] == padded and [len(x) for x in frames][-2:] == [1, 2]
    assert frames[0][0].width == 512 and frames[0][0].height == 8 and padded[0] == bytes(64)
    with pytest.raises(ValueError, match="JPEG"):
        jpeg.decode(b"PNG stuff", [(0, 9)])
    rows = jpeg.describe(jpeg.store(odd(spark).withColumnRenamed("text", "payload"))).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        if r.doc_id is not None:
            raw = (ODD[r.doc_id] or "").encode()
            assert bytes(r.thumbnail) == jpeg.pad(raw) and r.n_bytes == len(raw)


def test_jpeg_damage_is_a_row(spark: SparkSession) -> None:
    good = jpeg.write([jpeg.pad(b"some payload " * 40), jpeg.pad(b"another")])
    cuts = [good[0], b"PNG stuff", b"", None, good[0][:120], good[0].replace(b"\xff\xd0", b"\xff\x00"), good[0][:-40] + bytes(40), good[1], b"\xff\xd8\xff", good[0][:60] + b"\xff\xda\x00"]
    rows = {r.doc_id: r for r in jpeg.describe(spark.createDataFrame(list(enumerate(cuts)), "doc_id int, media binary")).collect()}
    assert len(rows) == len(cuts) and bytes(rows[0].thumbnail) == jpeg.pad(b"some payload " * 40) and bytes(rows[7].thumbnail) == jpeg.pad(b"another")
    assert rows[0].error is None and rows[7].error is None and rows[3].error is None and rows[3].thumbnail is None
    for i in (1, 2, 4, 5, 8, 9):
        assert rows[i].error and rows[i].thumbnail is None and rows[i].thumb_hash is None, i


def slow_decode(stream: bytes) -> bytes:
    """DC luminance of the frames of a grey stream, bit by bit, straight from the format's definition."""
    out, at = b"", 0
    while at < len(stream):
        tables, quant, height, width, at = {}, 0, 0, 0, at + 2
        while stream[at + 1] != 0xDA:
            kind, size = stream[at + 1], int.from_bytes(stream[at + 2 : at + 4], "big")
            body = stream[at + 4 : at + 2 + size]
            if kind == 0xDB:
                quant = body[1]
            elif kind == 0xC0:
                height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            elif kind == 0xC4:
                code, k, found = 0, 17, {}
                for n in range(1, 17):
                    for _ in range(body[n]):
                        found[f"{code:0{n}b}"] = body[k]
                        code, k = code + 1, k + 1
                    code *= 2
                tables[body[0]] = found
            at += 2 + size
        at += 2 + int.from_bytes(stream[at + 2 : at + 4], "big")
        rows = []
        for _ in range(height // 8):
            bits = ""
            while not (stream[at] == 0xFF and stream[at + 1] != 0):
                bits += f"{stream[at]:08b}"
                at += 2 if stream[at] == 0xFF else 1
            at, k, dc = at + 2, 0, 0

            def symbol(table: dict) -> int:
                nonlocal k
                n = next(n for n in range(1, 17) if bits[k : k + n] in table)  # noqa: B023
                k += n
                return table[bits[k - n : k]]  # noqa: B023

            for _ in range(width // 8):
                size = symbol(tables[0])
                if size:
                    v = int(bits[k : k + size], 2)
                    dc += v if bits[k] == "1" else v - (1 << size) + 1
                k += size
                assert symbol(tables[0x10]) == 0
                rows.append(round(dc * quant / 8 + 128))
        out += bytes(rows)
        if stream[at - 2 : at] != b"\xff\xd9":
            at += 2
    return out


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400))
def test_jpeg_by_a_decoder_of_its_own(payload: bytes) -> None:
    (stream,) = jpeg.write([jpeg.pad(payload)])
    assert slow_decode(stream) == jpeg.pad(payload) == jpeg.read([stream])[0][3]


def test_jpeg_feature_sees_all_frames(spark: SparkSession) -> None:
    one = "a" * (jpeg.ROW * jpeg.FRAME_ROWS)
    texts = [one + "a" * 300_000, one + "a" * 100_000 + "z" * 200_000, one]
    rows = {r.doc_id: r for r in jpeg.describe(jpeg.store(docs(spark, texts).withColumnRenamed("text", "payload"))).collect()}
    assert [rows[i].height for i in range(3)] == [8 * -(-len(t) // jpeg.ROW) for t in texts] and [rows[i].frames for i in range(3)] == [2, 2, 1]
    assert rows[0].thumb_hash != rows[1].thumb_hash
    joined = np.frombuffer(bytes(rows[1].thumbnail), np.uint8).reshape(-1, jpeg.ROW)
    assert rows[1].thumb_hash == jpeg.thumbnail_hash(joined)


def bits_to_bytes(bits: str) -> bytes:
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def test_jpeg_reads_colour_with_other_terms() -> None:
    """A 16x16 picture of three components, 2x2 sampling, with AC terms and no restart markers."""
    dc = {s: f"{c:0{n}b}" for c, n, s in jpeg.canonical(jpeg.DC_COUNTS, jpeg.DC_SYMBOLS)}
    ac_counts, ac_symbols = (0, 2, 1) + (0,) * 13, (0x00, 0x01, 0x21)
    ac = {s: f"{c:0{n}b}" for c, n, s in jpeg.canonical(ac_counts, ac_symbols)}
    number = lambda d: f"{d if d > 0 else d + (1 << abs(d).bit_length()) - 1:0{abs(d).bit_length()}b}" if d else ""
    block = lambda d, tail: dc[abs(d).bit_length()] + number(d) + tail + ac[0]
    bits = block(10, ac[0x01] + "1") + block(-3, ac[0x21] + "0") + block(0, "") + block(20, ac[0x01] + "0" + ac[0x21] + "1") + block(5, "") + block(-5, "")
    s = jpeg._segment
    data = b"\xff\xd8" + s(0xE0, b"JFIF\0") + s(0xDB, bytes([0, 4]) + bytes([1]) * 63)
    data += s(0xC0, b"\x08\x00\x10\x00\x10\x03" + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    data += s(0xC4, bytes([0, *jpeg.DC_COUNTS, *jpeg.DC_SYMBOLS])) + s(0xC4, bytes([0x10, *ac_counts, *ac_symbols]))
    data += s(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + bits_to_bytes(bits) + b"\xff\xd9"
    (frame,) = jpeg.decode(data, [(0, len(data))])[0]
    assert frame.luma.tolist() == [[133, 132], [132, 142]]  # running DC 10, 7, 7, 27 at quantiser 4


def test_two_pass_shuffle(spark: SparkSession) -> None:
    texts = [f"text {i}" for i in range(900)] + ["same"] * 400
    table = docs(spark, texts, [*range(900), *[7] * 400])
    found = shard.external_shuffle(table, 24, bucket_bytes=2000, bucket_rows=80).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((r.doc_id, r.text) for r in table.collect()) and found[0].h == 7
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = shard.external_shuffle(table.repartition(5), 24, bucket_bytes=2000, bucket_rows=80).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    assert shard.external_shuffle(table.limit(0), 3).count() == 0 and shard.external_shuffle(odd(spark), 3).count() == len(ODD) + 2


def clashing(spark: SparkSession, texts: list):
    """Columns with the names that the operators use inside."""
    names = ["_h", "__h", "h", "row", "bucket", "ordinal", "cell", "fine", "of", "border_cell", "before", "rest", "whole", "key", "n", "offset", "_cell", "_source", "__ordinal"]
    rows = [(i, t, "s", *([f"x{i}"] * len(names))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long, text string, source string", *(f"`{c}` string" for c in names)]))


def test_columns_with_clashing_names_are_kept(spark: SparkSession) -> None:
    table = clashing(spark, [*ODD, *["same"] * 40])
    want = Counter(map(tuple, table.collect()))
    for found in (mixing.mix(table), shard.external_shuffle(table, 5, bucket_rows=16)):
        assert found.columns[: len(table.columns)] == table.columns
        assert Counter(map(tuple, found.select(*table.columns).collect())) == want


def test_large_copies_are_spread_by_bytes(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(shard, "RUN", 4)
    table = docs(spark, ["x" * 3000] * 60 + [f"t{i}" for i in range(40)], [7] * 60 + list(range(100, 140)))
    found = shard.external_shuffle(table, 4, bucket_bytes=8000, bucket_rows=1000).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((r.doc_id, r.text) for r in table.collect())
    places = sorted((r.slot * 4 + r.shard, r.doc_id) for r in found)
    assert [p for p, _ in places] == list(range(100))
    runs = max(len(list(g)) for k, g in itertools.groupby(i == 7 for _, i in places) if k)
    assert runs < 20  # in one bucket they would stand together


def shuffled_by_hand(buckets: dict, shards: int, orders: dict) -> dict:
    """Places of rows that are sorted in their buckets, permuted by the given orders, and dealt out."""
    out, at = {}, 0
    for b in sorted(buckets):
        for k in orders[b]:
            out[buckets[b][k]] = (at % shards, at // shards)
            at += 1
    return out


def test_shuffle_by_hand(spark: SparkSession) -> None:
    table = docs(spark, [f"text {i}" for i in range(300)]).select("doc_id", "text")
    found = {r.doc_id: (r.shard, r.slot) for r in shard.external_shuffle(table, 7, bucket_rows=40).collect()}
    values = [F.col("doc_id"), F.col("text")]
    drawn = table.select("doc_id", F.pmod(F.xxhash64(F.lit(9), F.lit(0), *values), F.lit(8)).alias("b"), F.xxhash64(F.lit(~9), F.lit(0), *values).alias("h")).collect()
    buckets = defaultdict(list)
    for r in sorted(drawn, key=lambda r: r.h):
        buckets[r.b].append(r.doc_id)
    draws = spark.createDataFrame([(b, i) for b, x in buckets.items() for i in range(len(x))], "b int, i int").select("b", "i", F.pmod(F.xxhash64(F.lit(9), "b", "i"), F.col("i") + 1).alias("j")).collect()
    orders = {b: [] for b in buckets}
    for r in sorted(draws):
        done = orders[r.b]
        done.append(r.i)
        done[r.i], done[r.j] = done[r.j], done[r.i]
    assert found == shuffled_by_hand(buckets, 7, orders)


def test_shards_are_written_in_slot_order(spark: SparkSession, tmp_path) -> None:
    table = docs(spark, [f"text {i}" for i in range(200)])
    shard.write_shards(shard.external_shuffle(table, 6, bucket_rows=30), f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter(r.text for r in back.collect()) == Counter(f"text {i}" for i in range(200))
    for k in range(6):
        parts = sorted(Path(f"{tmp_path}/shards/shard={k}").glob("*.parquet"))
        slots = [r.slot for p in parts for r in spark.read.parquet(str(p)).collect()]
        assert sorted(slots) == list(range(len(slots))) and all(x == sorted(x) for x in [[r.slot for r in spark.read.parquet(str(p)).collect()] for p in parts])


def test_fisher_yates_is_a_permutation(spark: SparkSession) -> None:
    rows = spark.range(200).select(F.col("id").alias("b"), (F.col("id") % 40).cast("int").alias("n"))
    found = rows.select("n", shard.fisher_yates(F.col("n"), F.col("b"), 3).alias("p")).collect()
    assert all(sorted(r.p) == list(range(r.n)) for r in found)
    firsts = Counter(r.p[0] for r in spark.range(3000).select(shard.fisher_yates(F.lit(5), F.col("id"), 3).alias("p")).collect())
    assert len(firsts) == 5 and max(firsts.values()) < 700


def kt(a: int, b: int) -> float:
    out = 0.0
    for k in range(a):
        out += math.log((k + 0.5) / (k + 1))
    for k in range(b):
        out += math.log((k + 0.5) / (a + k + 1))
    return out


class ForcedTree:
    """Context-tree weighting by direct recursion over counts of contexts."""

    def __init__(self, texts: list[bytes], depth: int) -> None:
        self.depth, self.counts = depth, defaultdict(Counter)
        for t in texts:
            full = b"\n" * depth + t
            for i in range(depth, len(full)):
                for k in range(depth + 1):
                    self.counts[full[i - k : i]][full[i]] += 1
        self.below = defaultdict(list)
        for c in list(self.counts):
            if c:
                self.below[c[1:]].append(c)
        self.known: dict = {}

    def ab(self, context: bytes, prefix: str) -> tuple[int, int]:
        c = Counter()
        for byte, m in self.counts.get(context, {}).items():
            if f"{byte:08b}".startswith(prefix):
                c[f"{byte:08b}"[len(prefix)]] += m
        return c["0"], c["1"]

    def weighted(self, context: bytes, prefix: str) -> float:
        if (context, prefix) not in self.known:
            own = kt(*self.ab(context, prefix))
            if len(context) < self.depth:
                own = float(np.logaddexp(own, sum(self.weighted(c, prefix) for c in self.below[context]))) - math.log(2)
            self.known[context, prefix] = own
        return self.known[context, prefix]

    def mixture(self, context: bytes, prefix: str, k: int = 0) -> float:
        node = context[len(context) - k :]
        a, b = self.ab(node, prefix)
        p = (b + 0.5) / (a + b + 1)
        if k == self.depth:
            return p
        rest = sum(self.weighted(c, prefix) for c in self.below[node])
        beta = 1 / (1 + math.exp(rest - kt(a, b)))
        deeper = self.mixture(context, prefix, k + 1) if context[len(context) - k - 1 :] in self.counts else 0.5
        return beta * p + (1 - beta) * deeper

    def log10p(self, text: bytes) -> float:
        out, full = 0.0, b"\n" * self.depth + text
        for i in range(self.depth, len(full)):
            bits = f"{full[i]:08b}"
            for k in range(8):
                one = self.mixture(full[i - self.depth : i], bits[:k])
                out += math.log10(one if bits[k] == "1" else 1 - one)
        return out


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_context_tree_by_force(spark: SparkSession, depth: int, monkeypatch: pytest.MonkeyPatch) -> None:
    """Weights and mixtures of the spread tree against a direct recursion, in several chunks and runs."""
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcde é", k=rng.randint(0, 60))) for _ in range(30)] + [None, "", "unseen XYZ", "Ab ab"]
    monkeypatch.setattr(ctw, "CHUNK", 300)
    monkeypatch.setattr(ctw, "RUN", 50)
    monkeypatch.setattr(ctw, "SLICE", 100)
    table = docs(spark, texts)
    found = {r.doc_id: r for r in ctw.score(table, ctw.fit(table.where("doc_id < 20"), depth=depth)).collect()}
    joined = [b" ".join(ctw.tokens(t)) + b"\n" for t in texts]
    tree = ForcedTree(joined[:20], depth)
    assert len(found) == len(texts)
    for i, t in enumerate(joined):
        want = tree.log10p(t)
        assert found[i].score == pytest.approx(want, rel=1e-5)
        assert found[i].bits_per_byte == pytest.approx(-want * math.log2(10) / len(t), rel=1e-5)


def test_scores_and_base(spark: SparkSession) -> None:
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["the", "cat", "sat", "Mat", "on"], k=20)) for _ in range(200)] + ODD
    table = docs(spark, texts).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    for most in (2, 1000):  # with and without rare tokens
        model = ctw.fit(table.where("not held"), depth=3, max_frequent=most)
        found = {r.doc_id: r for r in ctw.score(table, model).collect()}
        train = Counter()
        for i, t in enumerate(texts):
            if zlib.crc32(str(i).encode()) % 7 != 2:
                train.update([*queries_words(t), "\n"])
        n, v = sum(train.values()), len(train)
        assert model.train_tokens == n
        for i, t in enumerate(texts):
            own = [*queries_words(t), "\n"]
            assert found[i].n_tokens == len(own) and found[i].n_known == sum(w in train for w in own)
            assert found[i].base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in own))
        assert all(r.score < 0 for r in found.values())
    blank = {r.doc_id: r for r in ctw.score(table, ctw.fit(table.limit(0))).collect()}
    assert blank[0].n_known == 0 and blank[0].bits_per_byte == pytest.approx(8, rel=1e-4)


def test_equal_texts_have_equal_scores(spark: SparkSession) -> None:
    table = docs(spark, [f"the cat {i % 7} sat" for i in range(3000)])
    found = ctw.score(table, ctw.fit(table, depth=4)).collect()
    assert len({(r.doc_id % 7, r.score) for r in found}) == 7


def test_context_tree_chunks_of_short_texts_and_copies(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Chunks are bounded by rows too, copies of a row are dealt over several, and scores are those of undealt rows."""
    rows = [(i, None) for i in range(600)] + [(None, None)] * 300 + [(7, "the cat sat on the mat again")] * 400 + [(1000 + i, f"the cat {i} sat") for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(16, F.rand(3)).checkpoint()
    model = ctw.fit(table, depth=3)
    want = Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in ctw.score(table, model).collect())
    monkeypatch.setattr(ctw, "CHUNK", 1500)
    monkeypatch.setattr(ctw, "CHUNK_ROWS", 100)
    placed, read = ctw.deal(table, "doc_id", "text")
    sizes = {r.chunk: r["count"] for r in placed.groupBy("chunk").count().collect()}
    assert sum(sizes.values()) == len(rows) and len(sizes) >= 6 and max(sizes.values()) < 400
    assert placed.where("doc_id = 7").where("text is not null").select("chunk").distinct().count() > 2
    assert placed.select("chunk", "text").subtract(read.select("chunk", "text")).count() == 0
    assert read.count() < len(rows)
    assert Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in ctw.score(table, model).collect()) == want


def shuffle_bytes(spark: SparkSession) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_") and f.getName().endswith(".data"))


def test_context_tree_lets_go_of_its_shuffles(spark: SparkSession) -> None:
    """What a step has shuffled goes when it is written: else the texts lie on the disk twice, beside all n-grams, until the last one ends."""
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcdefgh ", k=4000)) for _ in range(300)]
    table = docs(spark, texts).repartition(4, "doc_id").checkpoint()
    before = shuffle_bytes(spark)
    ctw.score(table, ctw.fit(table, depth=2))
    deadline = time.time() + 10  # files go in the background
    while (left := shuffle_bytes(spark) - before) > 100_000 and time.time() < deadline:
        time.sleep(0.2)
    assert left <= 100_000
    assert spark.conf.get(common.CLEANUP, None) is None


def test_distinct_codes() -> None:
    for codes in ([], [5], [3, 1, 3, 2, 1], [1 << 47, -1, 1 << 47]):
        assert ctw.distinct(np.array(codes, np.int64)).tolist() == sorted(set(codes))


DOCUMENT_QUERIES = ("op1_bpe_speculate_verify", "op5_capped_water_filling", "op6_word_first_backoff", "op7_setsketch_groups", "op8_jpeg_dc_thumbnails", "op9_two_pass_shuffle", "op10_context_tree_weighting")


def odd_pages(spark: SparkSession):
    """Null and odd urls and pages, a repeated row, a null id, one very long page, and columns whose names the operators use."""
    rows = [(0, None, None), (1, "odd", ""), (2, "https://a.example/", "<p>x" * 3), (2, "https://a.example/", "<p>x" * 3), (None, "https://a.example/b", "<p>y"), (3, "https://a.example/c", "<div>word " * 30_000)]
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], "page_id long, url string, html string, host string, content string, offset int")


def odd_vectors(spark: SparkSession):
    rows = [(0, None), (20, [1.0, 2.0]), (40, [1.0, 2.0]), (40, [1.0, 2.0]), (60, []), (80, [None, 1.0]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [0.5, -0.25])]
    return spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, near string")


def test_queries_run_on_odd_tables(spark: SparkSession, tmp_path) -> None:
    for name, table in (("documents", odd(spark)), ("pages", odd_pages(spark)), ("embeddings", odd_vectors(spark))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    for name in DOCUMENT_QUERIES:
        assert len(queries.QUERIES[name](spark, str(tmp_path)).collect()) == len(ODD) + 2, name
    pages = queries.QUERIES["op2_site_style_tree"](spark, str(tmp_path)).collect()
    assert Counter(r.page_id for r in pages) == {0: 1, 1: 1, 2: 2, None: 1, 3: 1} and {r.text for r in pages if r.page_id in (0, 1)} == {""}
    records = queries.QUERIES["op3_merkle_fixity"](spark, str(tmp_path)).collect()
    assert len(records) >= 6 and {r.verdict for r in records} == {"ok"}
    found = queries.QUERIES["op4_pivot_elimination"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == {(20, 1, 40, 20480), (20, 2, 7, 0), (40, 1, 20, 20480), (40, 2, 7, 0)}


def test_queries_run_on_empty_tables(spark: SparkSession, tmp_path) -> None:
    for name, table in (("documents", odd(spark)), ("pages", odd_pages(spark)), ("embeddings", odd_vectors(spark))):
        table.limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in (*DOCUMENT_QUERIES, "op2_site_style_tree", "op3_merkle_fixity", "op4_pivot_elimination"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0, name
