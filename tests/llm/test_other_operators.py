"""Vectors, chats, pages and the pipeline, against brute force on small fixtures."""

import random

import duckdb
import numpy as np
import pytest

from feedweave.llm import ann, chat, html_main, queries

SF = "/root/testdata/sf0.001"


# Nearest neighbours


def brute_nearest(vectors, asked, k):
    out = {}
    for q in asked:
        scores = sorted(((-float(np.dot(np.float64(vectors[q]), np.float64(v))), i) for i, v in vectors.items() if i != q))
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, extra string")


def test_nearest_reach_the_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    made = centres[np.arange(3000) % 20] + 0.7 * rng.normal(size=(3000, 16))
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    vectors = {i: v.tolist() for i, v in enumerate(made.astype(np.float32))}
    for i in range(2000, 2900):
        vectors[i] = vectors[2000]  # one very common vector
    df = frame(spark, vectors.items())
    rows = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    want = brute_nearest(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    found = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert found >= 0.93 * 20 * len(want)
    for q, near in got.items():
        for i, score in near:
            assert score == pytest.approx(float(np.dot(np.float64(vectors[q]), np.float64(vectors[i]))), abs=1e-9)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
    assert [i for i, _ in got[2020]] == [2000 + i for i in range(20)]


def test_nearest_of_odd_rows(spark):
    odd = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (40, [None, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0])]
    df = frame(spark, odd)
    rows = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect())
    assert rows == [(0, 1, 5), (0, 2, 20), (20, 1, 0), (20, 2, 5)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_vectors_of_different_lengths_are_refused(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0, 0.5, 0.1])])
    with pytest.raises(ValueError, match="from 2 to 4 components"):
        ann.nearest(df, df)


def test_norms_may_differ(spark):
    rng = np.random.default_rng(5)
    made = rng.normal(size=(1500, 12)) * np.exp(rng.normal(size=(1500, 1)) * 1.5) * 1e6
    vectors = {i: v.tolist() for i, v in enumerate(made.astype(np.float32))}
    df = frame(spark, vectors.items())
    want = brute_nearest(vectors, [i for i in vectors if i % 20 == 0], 20)
    found = sum(r["vec_id"] in {a for a, _ in want[r["query_id"]]} for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect())
    assert found >= 0.9 * 20 * len(want)


def test_best_bins_come_first():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 8))
    tree = ann.fit_tree(x)
    leaves = tree.assign(x)
    tree = tree.measured(*ann._leaf_sums(leaves, x, tree.leaves))
    finder = tree.searcher()
    promise = finder.promises(x[:200])
    assert set(leaves) <= set(range(tree.leaves)) and sorted(finder.order(promise[0], tree.leaves)) == sorted(set(leaves.tolist()))
    at = [finder.order(p, tree.leaves).index(leaf) for p, leaf in zip(promise, leaves, strict=False)]
    assert np.mean(at) < 0.15 * tree.leaves
    held = np.isfinite(tree.spread)
    for p in promise[:20]:  # a search that looks through all open nodes at every step
        open_, want = [0], []
        while open_:
            node = min(open_, key=lambda n: (-p[n], n))
            open_.remove(node)
            if tree.leaf[node] >= 0:
                want.append(int(tree.leaf[node]))
            open_ += [c for c in range(tree.first[node], tree.first[node] + tree.children[node]) if held[c]]
        assert finder.order(p, tree.leaves) == want


def test_blocks_hold_their_leaves(monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 10)
    first, parts = ann._blocks(np.array([3, 4, 0, 5, 25, 2, 9, 10]))
    assert first.tolist() == [0, 0, 0, 1, 2, 5, 6, 7] and parts.tolist() == [1, 1, 1, 1, 3, 1, 1, 1]


def test_cut_leaves_give_the_same_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(7)
    df = frame(spark, [(i, rng.normal(size=6).tolist()) for i in range(600)])
    want = sorted(map(tuple, ann.nearest(df, df.where("vec_id % 20 = 0")).collect()))
    monkeypatch.setattr(ann, "BLOCK", 3)
    assert sorted(map(tuple, ann.nearest(df, df.where("vec_id % 20 = 0")).collect())) == want


def test_nearest_of_the_table_scan_a_part_of_it(spark):
    """Recall against brute force and the share of the vectors scanned, on a whole table."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    got = {}
    scanned = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
        scanned[r["query_id"]] = r["scanned"]
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(got[ids[q]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    print("recall", np.mean(hits), "scanned", np.mean(list(scanned.values())) / len(x))
    assert np.mean(hits) >= 0.9 and np.mean(list(scanned.values())) < 0.2 * len(x)


# Chats


def brute_chats(turns):
    whole = {}
    for c, t, r, x in turns:
        whole.setdefault(c, []).append((t, r or "unknown", x or ""))
    seqs = {}
    for c, rows in whole.items():
        by_turn = {}
        for t, r, x in sorted(rows, key=lambda y: (y[0], y[1], y[2])):
            by_turn.setdefault(t, []).append((r, x))
        seqs[c] = tuple(tuple(by_turn[t]) for t in sorted(by_turn))
    kept = {}
    for c in sorted(seqs):
        s = seqs[c]
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())
        if not longer and s not in kept.values():
            kept[c] = s
    return {c: "".join(f"<|{r}|>\n{x}\n" for slot in s for r, x in slot) for c, s in kept.items()}


def test_only_maximal_conversations_are_rendered(spark, monkeypatch):
    rng = random.Random(3)
    turns = []
    for c in range(60):
        root, n = rng.randrange(4), rng.randrange(1, 9)
        for t in range(n):
            turns.append((c, t + 5 * (c % 2), "user" if t % 2 == 0 else "assistant", f"{root}-{t if t < 5 else rng.randrange(2)}"))
    turns += [(70, 0, None, None), (70, 0, None, None), (71, 0, "user", "tie b"), (71, 0, "user", "tie a"), (72, 0, "user", "tie a"), (72, 0, "user", "tie b"), (72, 1, "user", "more")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, extra string")
    for stretch in (512, 3):
        monkeypatch.setattr(chat, "STRETCH", stretch)
        got = {}
        for r in sorted(chat.render(df).collect(), key=lambda r: (r["conv_id"], r["part"])):
            got[r["conv_id"]] = got.get(r["conv_id"], "") + r["formatted"]
        assert got == brute_chats(turns)
    assert chat.render(df.limit(0)).count() == 0


def test_chats_of_one_long_conversation(spark):
    turns = [(1, t, "user", f"t{t}") for t in range(3000)] + [(2, t, "user", f"t{t}") for t in range(2900)] + [(3, 5, "user", "é" * 200_000)]
    got = {}
    for r in sorted(chat.render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: (r["conv_id"], r["part"])):
        assert r["n_turns"] == (3000 if r["conv_id"] == 1 else 1)
        got[r["conv_id"]] = got.get(r["conv_id"], "") + r["formatted"]
    assert got == {1: "".join(f"<|user|>\nt{t}\n" for t in range(3000)), 3: "<|user|>\n" + "é" * 200_000 + "\n"}


def test_chats_of_null_keys(spark):
    df = spark.createDataFrame([(None, None, "user", "a"), (None, 1, "user", "b"), (1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    got = sorted((r["part"], r["conv_id"], r["formatted"]) for r in chat.render(df).collect())
    assert got == [(0, None, "<|user|>\na\n"), (1, None, "<|user|>\nb\n")]  # the other is its prefix by places


def test_chats_run_no_python(spark, capsys):
    df = queries.op4_chat(spark, SF)
    df.explain("formatted")
    assert not any(x in capsys.readouterr().out for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_give_the_rows_of_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


# Pages


def page(text, extra=""):
    return f'<html><head><title>T</title><style>a</style></head><body><header>Site</header><nav><a href="/">Home</a></nav><div class="ad">Buy now, a long advertisement text</div><article class="post-{len(text)}">{text}</article>{extra}<aside>More</aside><footer>&copy; all</footer></body></html>'


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (page("<h1>A &amp; B</h1><p>one\n  <b>two</b>&nbsp;three<br>four<p>five"), "A & B\none two three four\nfive"),
        (page("<p>long enough text here</p><div class='comments'><p>I disagree</p></div><form><input><p>x</p></form><script>p()</script>"), "long enough text here"),
        (page("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>"), "a\nb\nc\nd"),
        (page(""), ""),
        ("", ""),
        (None, ""),
        ("no markup at all", "no markup at all"),
        ("<p>unclosed <b>x", "unclosed x"),
        ("<div class='x'><p>only &lt;this&gt; is here, &am and &amp</p></div>", "only <this> is here, &am and &"),
    ],
)
def test_main_text_of_a_page(html, text):
    p = html_main.Page(html or "")
    assert p.text(html_main.path_of("body", "none")) == text == p.text(None) or (html == page("") and p.text(None) in ("", text))


def test_a_host_agrees_on_a_path(spark):
    # the comments of the last page are longer than its story, but not those of the host's others
    body = lambda story, talk: f'<body><div class="story-9"><p>{story}</p></div><div class="talk"><p>{talk}</p></div></body>'
    rows = [(i, f"https://H.example/{i}", body("story " * 40, "talk"), "x") for i in range(9)] + [(9, "http://h.example:80/9?x", body("short story", "talk " * 90), "x"), (10, None, "<p>alone</p>", "x"), (11, "https://h.example/11", None, "x"), (None, "nohost", "<p>b</p>", "x"), (0, "https://h.example/0", body("again", ""), "x")]
    made = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = html_main.extract(made).collect()
    got = {r["page_id"]: r for r in out if r["page_id"] != 0}
    assert (got[9]["text"], got[10]["text"], got[11]["text"], got[11]["n_chars"], got[None]["text"]) == ("short story", "alone", "", 0, "b")
    assert len(out) == 14 and sorted(r["text"][:5] for r in out if r["page_id"] == 0) == ["again", "story"] and all(r["n_chars"] == len(r["text"]) for r in out)
    winners = {r["host"]: r["path"] for r in html_main.host_paths(html_main.parsed(made)).collect()}
    assert winners["h.example"] == html_main.path_of("body", "div.story-#")
    assert html_main.extract(made.limit(0)).count() == 0


def test_text_of_the_table_is_that_of_its_articles(spark):
    """The pages given have their text in one article element, cut out here by patterns."""
    import html as entities
    import re

    def article(raw):
        found = re.search(r"<article>(.*?)(?:</article>|<footer|$)", raw or "", re.S)
        parts = re.split(r"</?(?:p|h1)(?: [^>]*)?>", re.sub(r"<br[^>]*>", " ", found[1])) if found else []
        return "\n".join(t for t in (" ".join(entities.unescape(re.sub("<[^>]+>", "", x)).split()) for x in parts) if t)

    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in table.collect()}
    got = {r["page_id"]: r["text"] for r in html_main.extract(table).collect()}
    assert got == {i: article(h) for i, h in raw.items()}


def planted(rng, i):
    """A page in one of some layouts, with the words that belong to its main text and the others."""
    word = lambda kind: f"{kind}{rng.randrange(10**9)}"
    mine, other = [[word("m") for _ in range(rng.randrange(5, 40))] for _ in range(rng.randrange(2, 6))], []

    def noise(n):
        other.extend(ws := [word("x") for _ in range(n)])
        return " ".join(ws)

    body = "".join(rng.choice(["<p>{}</p>", "<p><b>{}</b>", "<ul><li>{}</ul>", "<blockquote>{}</blockquote>"]).format(" ".join(ws)) for ws in mine)
    inner = body[: len(body) // 2].rpartition("<p>")[0]
    ad = f'<div class="ad-{i}">{noise(6)}</div>'
    body = body.replace(inner, inner + ad, 1) if inner else body + ad
    comments = f'<section id="comments"><p>{noise(rng.randrange(5, 60))}</p></section>'
    head = f'<header>{noise(3)}</header><nav><a href="/">{noise(2)}</a></nav><div class="cookie-notice">{noise(5)}</div>'
    foot = f'<aside><p>{noise(8)}</p></aside><form><label>{noise(2)}</label></form><footer>{noise(6)}</footer>'
    layout, cut = i % 6, body.find("<p>", len(body) // 3)
    cut = cut if cut > 0 else len(body)
    main = [f"<article>{body}</article>", f'<div class="page with-sidebar"><div class="entry-content side-by-side">{body}</div></div>', f'<form action="/"><main class="alerts">{body}</main></form>'.replace("form", "div"), f'<div id="story"><div class="text">{body}</div></div>', f'<div class="post">{body}</div>', f'<div class="post-top">{body[:cut]}</div><div class="post-rest">{body[cut:]}</div>'][layout]
    return f"https://site{layout}.example/{i}", f"<html><body>{head}{main}{comments}{foot}</body></html>", [w for ws in mine for w in ws], other


def test_planted_pages_are_told_from_what_is_around_them(spark):
    rng = random.Random(15)
    made = [planted(rng, i) for i in range(120)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _, _) in enumerate(made)], "page_id long, url string, html string")
    right = wrong = missed = 0
    for r in html_main.extract(df).collect():
        _, _, mine, other = made[r["page_id"]]
        words = set(r["text"].split())
        right, wrong, missed = right + len(words & set(mine)), wrong + len(words & set(other)), missed + len(set(mine) - words)
    print("precision", right / (right + wrong), "recall", right / (right + missed))
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.98


LONG, MORE = ("a long text of the page itself " * 14).strip(), ("and the rest of it " * 24).strip()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<body><div class="post">{LONG}</div><div class="post-more">{MORE}</div></body>', f"{LONG}\n{MORE}"),
        (f'<body><div class="post">{LONG}</div><div class="post">{MORE}</div><div class="extra">x</div></body>', f"{LONG}\n{MORE}"),
        *((f"<article><p>{LONG}</p><div {n}><p>{MORE}</p></div></article>", f"{LONG}\n{MORE}") for n in ('class="social-policy"', 'class="notice-of-meeting"', 'id="related-work"')),
        *((f'<article><p>{LONG}</p><div class="{n}"><p>{MORE}</p></div></article>', LONG) for n in ("social-links", "related-posts", "comment-list", "ad-300", "notice")),
        (f'<article><p>{LONG}</p><div class="related-work"><a href="/">{MORE}</a></div></article>', LONG),
        (f"<header><h1>Site</h1></header><article><header><h1>Title</h1><nav>Home</nav></header><p>{LONG}</p><footer>x</footer></article>", f"Title\n{LONG}"),
        (f'<body><h1>Title</h1><div class="content"><p>{LONG}</p></div></body>', f"Title\n{LONG}"),
        (f'<body><h1><a href="/">Site</a></h1><div class="content"><p>{LONG}</p></div></body>', LONG),
        (f"<body><h1>Site</h1><article><p>{LONG}</p></article></body>", LONG),
        (f'<main><article><p>short</p></article><div id="comments"><ol class="comment-list"><li><article class="comment-body"><p>{MORE}</p></article></ol></div></main>', "short"),
        (f"<form><article><p>{LONG}</p></article><p>{MORE}</p></form>", LONG),
        (f"<form><p>{LONG}</p></form>", ""),
        (f'<form><p>{LONG}</p></form><div class="sidebar">{MORE}</div>', MORE),
    ],
)
def test_articles_are_kept_whole(html, text):
    assert html_main.Page(html).text(None) == text


def brute_main_text(pages):
    """Votes and texts of pages [(host, Page)], each score from its definition and no sums carried up."""

    def chain(page, c):
        while c >= 0:
            yield c
            c = page.parents[c]

    def scores(page):
        out = [0.0] * len(page.parents)
        for text, linked, at, _, _ in page.blocks:
            for depth, c in enumerate(chain(page, at)):
                out[c] += page.weights[c] * max(0, len(text) - 2 * linked) * 0.7**depth
        return out

    votes, up, main = {}, {}, {}
    for host, page in pages:
        got = scores(page)
        for c, s in enumerate(got):
            if host and s > 0.2 * max(got):
                key = host, page.paths[c]
                votes[key] = votes.get(key, 0) + int(round(s / max(got), 3) * 1000 + 1e-6)
                up[key], main[key] = page.paths[page.parents[c]] if page.parents[c] >= 0 else 0, page.weights[c] == 3
    for host, page in pages:
        mine = {p: v for (h, p), v in votes.items() if h == host}
        best = min(mine, key=lambda p: (-mine[p], p)) if mine else None
        chosen = {c for c, p in enumerate(page.paths) if p == best}
        holding = lambda chosen: [b for b in page.blocks if chosen & set(chain(page, b[2]))]  # noqa: B023, E731
        if holding(chosen):
            like = {p for p in mine if 4 * mine[p] >= mine[best] and up[host, p] == up[host, best] and main[host, p] == main[host, best]}
            chosen = {c for c, p in enumerate(page.paths) if p in like}
        else:
            got = scores(page)
            top = got.index(max(got))
            chosen = {c for c, s in enumerate(got) if 4 * s >= got[top] and page.parents[c] == page.parents[top] and (page.weights[c] == 3) == (page.weights[top] == 3)}
        yield "\n".join(b[0] for b in holding(chosen))


def test_votes_and_texts_equal_brute_force(spark):
    rng = random.Random(21)
    part = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for i in range(160):
        site = i % 8
        pieces = ["".join(f"<p>{part(rng.randrange(3, 30))}</p>" for _ in range(rng.randrange(1, 5))) for _ in range(3)]
        talk = f'<div class="talk"><p>{part(rng.randrange(1, 40))}</p></div>'
        more = f'<div class="{rng.choice(["post-more", "rest", "post"])}">{pieces[1]}</div>'
        links = f'<div class="x"><a href="/">{part(20)}</a></div>'
        body = [f'<div class="post">{pieces[0]}</div>{more}', f"<article>{pieces[0]}</article>{links}<article>{pieces[1]}</article>", f'<div id="story"><div>{pieces[0]}</div><section>{pieces[1]}{links}</section></div>', f"<div><div><div>{pieces[0]}</div></div>{more}</div>"][site % 4]
        if rng.random() < 0.1:
            body = f"<section>{pieces[2]}</section>"
        rows.append((i, f"http://site{site}.example/{i}" if i % 11 else None, f"<body>{body}{talk}</body>"))
    got = {r["page_id"]: r["text"] for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = brute_main_text([(u and u.split("/")[2], html_main.Page(h)) for _, u, h in rows])
    assert [got[i] for i in range(160)] == list(want)


def test_marked_elements_that_are_the_page_stay():
    text = lambda h: html_main.Page(h).text(None)
    long = "a long text of the page itself " * 5
    assert text(f'<div class="sidebar"><p>{long}</p></div><div>x</div>') == long.strip()
    assert text(f'<div class="ads"><article><p>{long}</p></article></div>') == long.strip()
    assert text(f'<article><p>{long}</p><p class="tags">kept</p><p class="advert">gone</p></article>') == f"{long.strip()}\nkept"


@pytest.mark.parametrize("one", ["<div>a", "<b>a", "<div><p>a<b>", "<i><p>a<b></i>", "<li>a</ul>", "<a>a</span>"])
def test_nesting_takes_time_in_proportion(one):
    import time

    began = time.process_time()
    page = html_main.Page(one * 30_000)
    assert page.text(None) and time.process_time() - began < 15


# Registered queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_pipeline_stages_do_what_they_say(spark):
    import corpus_pipeline as P
    from feedweave.llm import decontaminate, pipeline, secrets
    from tests.llm.test_text_operators import brute_components

    made = spark.read.parquet(f"{SF}/documents.parquet")
    kept = made
    seen = []
    for name, stage in P.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == list(pipeline.COLUMNS) and kept.count() <= before.count()
        seen.append((name, before, kept))
    _, before, after = seen[1]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    _, homes = brute_components([t for _, t in rows], 5, 80)
    assert sorted(r["doc_id"] for r in after.collect()) == [d for i, (d, _) in enumerate(rows) if homes[i] == i]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.leaks(seen[2][2], bench).count() == 0
    items = [r["text"] for r in bench.collect()]
    gone = {r["doc_id"] for r in seen[2][1].collect()} - {r["doc_id"] for r in seen[2][2].collect()}
    assert gone == {r["doc_id"] for r in seen[2][1].collect() if any(x in r["text"] for x in items)}
    assert seen[3][1].count() == seen[3][2].count() and secrets.scan(seen[3][2]).where("size(secrets) > 0").count() == 0
    assert P.STAGES[-1][1](spark, kept, SF).select("doc_id").distinct().count() == kept.count()


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as P

    sf = str(tmp_path)
    long = " ".join(f"w{i}" for i in range(60_000))
    item = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, None, None, None, None), (None, "some words of nobody", "en", "web", 5), (None, "some words of nobody", "en", "web", 5), (2, "", "en", "web", 0), (3, long, "en", "web", 9), (4, long + " end", "en", "web", 9), (5, f"before {item} after", "en", "web", 9), (6, "the password=hunter22 is here", "en", "web", 30), (6, "the password=hunter22 is here", "en", "web", 30), (7, "you idiot moron and loser", "de", None, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept int")
    spark.createDataFrame([(7, 1, 1), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    got = kept.collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 0, 1, 2, 3, 6, 6]
    assert {r["text"] for r in got if r["doc_id"] == 6} == {"the [assign] is here"} and {r["n_chars"] for r in got if r["doc_id"] == 6} == {20}
    last = P.STAGES[-1][1](spark, kept, sf).collect()
    assert len({(r["doc_id"], r["sample"]) for r in last}) == 8 and all(r["round_trip"] for r in last)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
