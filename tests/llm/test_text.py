"""BPE, language ID, packing, licences, HTML and quality rules against brute force."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kmerloom.llm import bpe, html_text, language, licenses, packing, repetition

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, ids string, score string"
rng = random.Random(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def table(spark, rows):
    return spark.createDataFrame([(d, t, g, "s", "x", "y") for d, t, g in rows], SCHEMA)


def sample_texts():
    words = ["the", "There", "ünï", "naïve's", "日本語", "123", "4½", "it's", "DON'T", "😀", "<|endoftext|>", "a" * 300, "\n\n", "  ", "\t", "\x1c", "\xa0", "!!", "x_y"]
    return [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 3, 9, 40, 400)] + ["", "a", " ", "\n", " lead", "trail ", "a  b", "a \n b"]


def test_bpe_against_library(spark, library):
    texts = [*sample_texts(), None, "word " * 60_000]
    rows = table(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(0, texts[0], None)])
    got = {r.doc_id: r for r in bpe.encode_decode(rows, PATH).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    back = bpe.decoded(bpe.encoded(rows, PATH), PATH).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert bpe.encode_decode(rows.limit(0), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(library, text):
    model = bpe.automaton(PATH, bpe.word_pattern(PATH))
    assert model.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert model.decode(model.encode(text)) == text


def test_bpe_every_code_point(library):
    """Each code point between two letters, and random texts over all of them."""
    model = bpe.automaton(PATH, bpe.word_pattern(PATH))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b " for c in points[at : at + 500]) for at in range(0, len(points), 500)]
    few = [9, 10, 13, 28, 32, 32, 39, 0x85, 0xA0, 0x200B, 0x2028]
    for _ in range(30_000):
        kind = lambda: rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x800), rng.randrange(0x800, 0xD800), rng.randrange(0xE000, 0x110000), rng.choice(few)])
        texts.append("".join(chr(kind()) for _ in range(rng.randrange(1, 30))))
    assert [model.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def gadget_sets(model, merges):
    """The successive merge gadgets on explicit sets: state -> {arc: state}."""
    states = [{t: 0 for t in model.tokens if not model.born[t]}]
    for u, v, uv in merges:
        q = next(arcs[u] for arcs in states if u in arcs)
        states.append({t: s for t, s in states[q].items() if t != v})
        to = states[q][v]
        for arcs in states:
            if u in arcs:
                arcs[u] = len(states) - 1
                arcs[uv] = to
    return states


def test_gadgets_are_the_explicit_automaton(tmp_path):
    """The compiled tables against the automaton built arc by arc, for the first merges of the vocabulary."""
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][:150]
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made = {u + v for u, v in merges}
    spec["model"]["vocab"] = {t: i for t, i in spec["model"]["vocab"].items() if len(t) == 1 or t in made}
    small = tmp_path / "small.json"
    small.write_text(json.dumps(spec))
    model = bpe.TokenAutomaton(str(small), bpe.word_pattern(PATH))
    vocab = spec["model"]["vocab"]
    states = gadget_sets(model, [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges])
    for u in model.tokens:
        arcs = states[next(arcs[u] for arcs in states if u in arcs)]
        assert [v for v in model.tokens if model.leaves(u, v)] == [v for v in model.tokens if v in arcs]


def best_fit_decreasing(sizes, capacity):
    """Free places of the sequences that plain best fit, one piece at a time, longest first, makes."""
    free = []
    for n in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(free) if room >= n]
        k = min(fits, key=free.__getitem__) if fits else len(free)
        free[k : k + 1] = [free[k] - n if fits else capacity - n]
    return free


def test_packing(spark, library):
    texts = [None, "", "one", "a b c " * 700, "x " * 1023, "x " * 1024] + [" ".join(["word"] * rng.randint(1, 900)) for _ in range(120)]
    rows = table(spark, [(i, t, None) for i, t in enumerate(texts)] + [(2, "one", None)])
    got = packing.pack(rows, PATH).collect()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    assert sum(r.length for r in got) == sum(map(len, ids.values())) + len(ids[2])
    by_seq = {}
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.length == 1024 or r.piece == 0
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(by_seq) <= len(best_fit_decreasing([r.length for r in got], 1024)) + 1
    assert packing.pack(rows.limit(0), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan(counts):
    """Every rank has one place, sequences are gapless and no fuller than they can be; two large pieces at most."""
    rules = packing.plan(counts, 64)
    seqs, seen = {}, Counter()
    for length, lo, hi, first, each, at in rules:
        assert lo == seen[length]
        seen[length] = hi
        for r in range(lo, hi):
            seqs.setdefault(first + (r - lo) // each, []).append((at + (r - lo) % each * length, length))
    assert seen == Counter(counts)
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64 and sum(3 * n > 64 for _, n in parts) <= 2
    total = sum(k * n for k, n in counts.items())
    large = sum(n for k, n in counts.items() if 2 * k > 64)
    assert len(seqs) <= max(large, 1.5 * total / 64 + 1) * 1.25 + 1


def test_language(spark):
    alphabet = {"aa": "abcde", "bb": "defgh", "cc": "äöüßé"}
    rows = [(d, " ".join("".join(rng.choice(alphabet[g]) for _ in range(5)) for _ in range(30)), g) for d in range(240) for g in [rng.choice("abc") * 2]]
    rows += [(240, None, "aa"), (241, "123 --", "bb"), (242, "", None), (243, "abcab", None), (None, "dfghh dfghh", "bb"), (244, "ÄÖÜ " * 100_000, None), rows[0]]
    got = language.identify(table(spark, rows), per_language=60).collect()
    assert len(got) == len(rows)
    truth = {d: g for d, _, g in rows if d is not None and d < 240}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.held_out for r in got} == {True, False} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95
    by = {r.doc_id: r for r in got}
    assert all((by[d].lang_pred, by[d].score) == ("und", 0.0) for d in (240, 241, 242)) and by[244].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got)
    assert language.identify(table(spark, rows).limit(0)).count() == 0
    unlabelled = language.identify(table(spark, [(1, "abc", None)])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


def test_ngrams_over_pieces(monkeypatch):
    text = "".join(rng.choice("abc dé") for _ in range(3000))
    whole = language.ngram_counts(text)
    monkeypatch.setattr(language, "_STEP", 100)
    parts = language.ngram_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def slow_licenses(text, least):
    """Lines, sentences and the whole against all templates, and every window of a template's length against it."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    squeeze = lambda s: " ".join(re.findall("[a-z0-9]+", s))
    pairs = lambda w: set(zip(w, w[1:], strict=False))
    names, best = set(), None
    words = squeeze(low).split()
    units = {squeeze(x) for x in [*low.split("\n"), *re.split(r"[.!?]+(?:[ \n]|$)", low), low]}
    for name, t in licenses.TEMPLATES:
        own = licenses.normal_words(t)
        b = pairs(own)
        windows = [words[i : i + len(own)] for i in range(len(words) - len(own) + 1)] if len(words) < 3000 else []
        for w in [u.split() for u in units] + windows:
            a = pairs(w)
            d = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if d >= least:
                names.add(name)
                best = max(best or 0, d)
    return ",".join(sorted(names)), best


def altered(text, share):
    """A share of a text's words changed, left out, doubled or swapped with the next."""
    w = text.split()
    for i in rng.sample(range(len(w) - 1), max(1, int(share * len(w)))):
        kind = rng.randrange(4)
        if kind == 0:
            w[i] = "other"
        elif kind == 1:
            w[i] = ""
        elif kind == 2:
            w[i] += " " + w[i]
        else:
            w[i], w[i + 1] = w[i + 1], w[i]
    return " ".join(w)


def test_licenses(spark):
    noise = lambda: " ".join(rng.choice(["license", "the", "software", "free", "mit", "granted"]) for _ in range(40))
    texts = [None, "", "Released under the MIT License.", f"intro\n{licenses.MIT}\nend {noise()}", f"{noise()} {licenses.BSD_START} {licenses.BSD_END}", licenses.ZLIB.upper()]
    texts += [licenses.APACHE.replace("compliance", "accord"), "x " * 40_000 + "\nLicensed under CC BY-NC 4.0.", "A line. Licensed under the Apache License, Version 2.0. More.", noise(), noise()]
    texts += ["This project is licensed under the MIT License - see the LICENSE file for details", f"{noise()} Permission hereby is {licenses.MIT[28:]} {noise()} {noise()} {noise()}", "license", "mit"]
    got = {r.doc_id: r for r in licenses.scan(table(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        names, best = slow_licenses(t, 0.8)
        assert got[i].licenses == names, i
        assert best is None and got[i].best_dice is None or 0.95 * best <= got[i].best_dice <= best + 1e-6
    assert got[3].licenses == got[12].licenses == got[11].licenses == "MIT" and got[7].licenses == "CC-BY-NC-4.0"
    twice = table(spark, [(1, texts[2], None), (1, texts[2], None), (None, texts[2], None)])
    assert sorted((str(r.doc_id), r.licenses) for r in licenses.scan(twice).collect()) == [("1", "MIT"), ("None", "MIT")]
    assert licenses.scan(twice.limit(0)).count() == 0


def test_altered_licenses_inside_code(spark):
    """Recall of altered notices in the midst of other words, against every window: what reaches 0.8 somewhere is found."""
    code = lambda n: " ".join(rng.choice(["int", "x", "return", "for", "the", "value", "of", "license_key", "if", "0"]) for _ in range(n))
    long_ones = [(name, t) for name, t in licenses.TEMPLATES if len(licenses.normal_words(t)) >= 20]
    cases = [f"{code(150)} {altered(t, share)} {code(150)}" for _, t in long_ones for share in (0.02, 0.05, 0.08)]
    want = [set(slow_licenses(t, 0.8)[0].split(",")) - {""} for t in cases]
    got = {r.doc_id: set(r.licenses.split(",")) - {""} for r in licenses.scan(table(spark, [(i, t, None) for i, t in enumerate(cases)])).collect()}
    due = sum(map(len, want))
    assert due >= 25 and sum(len(w & got[i]) for i, w in enumerate(want)) >= 0.95 * due
    sizes = {len(licenses.normal_words(t)) for _, t in licenses.TEMPLATES}
    pairs = lambda w: set(zip(w, w[1:], strict=False))
    for i, w in enumerate(want):  # a window laid for one template may fit another
        words = licenses.normal_words(cases[i])
        for name in got[i] - w:
            own = [pairs(licenses.normal_words(t)) for n, t in licenses.TEMPLATES if n == name]
            cut = [pairs(words[at : at + n]) for n in sizes for at in range(len(words) - n + 1)]
            assert any(2 * len(a & b) >= 0.8 * (len(a) + len(b)) for a in cut for b in own)


def test_license_sql(spark):
    import duckdb

    texts = [None, "", licenses.MIT, f"see {licenses.APACHE} there", "Released under the MIT License. Or the ISC License", "This is licensed under the GNU General Public License, version 3 only", altered(licenses.ISC, 0.05)]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    documents = table(spark, rows).toPandas()
    want = duckdb.sql(licenses.scan_sql(0.8)).df()
    got = licenses.scan(table(spark, rows)).toPandas()
    assert len(documents) == len(texts)
    for frame in (want, got):
        frame["best_dice"] = frame["best_dice"].fillna(-1.0)
    key = lambda f: sorted(map(tuple, f[["doc_id", "licenses", "best_dice", "n_units"]].values.tolist()))
    assert key(got) == key(want)


def test_packing_encoders_agree(library):
    """Both encoders on each side of the switch between them, and with special tokens and other scripts."""
    texts = [unit * n for unit in ("a", "é", "日", "ab ", " ", "\n", "!", "1") for n in (1, 999, 1000, 1001, 1500)]
    texts += [f"x{'y' * n} z\n\n  tail" for n in (998, 999, 1000)] + ["a<|endoftext|>b", "<|endoftext", *sample_texts(), "".join(map(chr, range(0xA0, 0x3000)))]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing._encoder(PATH).encode(texts) == want


def test_html(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var x='</p>'</script></head><body><header>Site name</header><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class='cookie-notice'><p>We use cookies, and more. Please accept them all, thanks.</p></div><!-- <p>gone</p> -->"
        "<main><h1>Head &amp; line</h1><p>First  para,\n with <b>bold</b> text. It is long enough, surely.<p>Second&nbsp;one,<br>broken. And so on, and on.<ul><li>item one here</ul>"
        "<aside>Side</aside><form><input><p>Name</p></form></main><section id=comments><p>Great post, thanks a lot, really. I liked it very much.</p></section><footer>&copy; x</footer></body></html>"
    )
    want = "Head & line\n\nFirst para, with bold text. It is long enough, surely.\n\nSecond one, broken. And so on, and on.\n\nitem one here"
    div = "<body><ul class=menu><li><a>One</a><li><a>Two</a></ul><div class=post>" + "<p>Some sentence, of the text. And one more.</p>" * 3 + "</div><div class=ad><p>Buy now, cheap. Do it, today!</p></div></body>"
    htmls = [page, None, "", "plain <words> only", div, "<p>unclosed <b>x" + "<div>" * 2000, "<script>only", "<article>" + "<p>word, word. </p>" * 5000 + "</article>"]
    rows = spark.createDataFrame([(i, f"u{i}", h, "extra") for i, h in enumerate(htmls)], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(rows).collect()}
    assert got[0].text == want and got[1].text == got[2].text == got[6].text == ""
    assert got[4].text == "\n\n".join(["Some sentence, of the text. And one more."] * 3)
    assert got[5].text == "unclosed x" and got[7].text.count("\n\n") == 4999
    assert all(r.n_chars == len(r.text) for r in got.values()) and html_text.extract(rows.limit(0)).count() == 0


SENTENCE = "Some sentence, of the text, long enough to be read by people. And one more, with a comma, here it is."


@pytest.mark.parametrize("name", "legal search-results ad-hoc related-work social-history top tags side share-price comment overlay notice".split())
@pytest.mark.parametrize("main", ["<div class=content>", "<article>"])
def test_class_of_a_paragraph_only_lowers(name, main):
    page = (
        f"<body><nav><ul><li><a href=/>Home</a></ul></nav>{main}<h1>Title of it</h1>" + f"<p>{SENTENCE}</p>" * 3 + f"<p class='{name}'>Special: {SENTENCE}</p>" + f"<p>{SENTENCE}</p>" * 2
        + "</div></article><div class=comments><div class=comment><p>Great post, thanks a lot. I liked it.</p></div></div><footer>Copyright, all rights reserved. Read the terms, please.</footer>"
    )
    assert html_text.main_text(page).split("\n\n") == ["Title of it", *[SENTENCE] * 3, f"Special: {SENTENCE}", *[SENTENCE] * 2]


def test_whole_page_in_a_form_or_cue():
    for opening in ("<form>", "<div class='site has-sidebar'>", "<section class=legal>", "<div class=overlay id=comments>"):
        assert html_text.main_text(f"<body>{opening}<p>{SENTENCE}</p><p>{SENTENCE}</p>") == f"{SENTENCE}\n\n{SENTENCE}"
    assert html_text.main_text(f"<p>{SENTENCE}</p><a href=x><div>Linked text in a block, here.</div></a>") == SENTENCE
    assert html_text.main_text("<p>x <math><mi>a</mi><mo>=</mo><mn>1</mn></math> y, a formula.</p>") == "x a=1 y, a formula."


def test_broken_and_deep_pages_in_linear_time():
    began = time.process_time()
    for page in ("<div>x, text. " * 5000, '<a "' * 50_000, "<a '>'" * 50_000 + '"', "<div>" * 5000 + "</p></li></span>" * 20_000 + "<p>x", "<ul><li>" * 5000 + "<li>a" * 20_000, "<" * 100_000, "<!--" * 50_000, "<!" * 50_000):
        html_text.main_text(page)
    assert time.process_time() - began < 8
    assert html_text.main_text(f"<p title='x>{SENTENCE}</p><p>{SENTENCE}</p>").endswith(SENTENCE)


def test_path_sums(spark):
    """Ratios of paths against sums over explicit paths of random pages."""
    for _ in range(60):
        want: dict[tuple, list[float]] = {}

        def grow(path, depth):
            out = ""
            for _ in range(rng.randint(1, 4)):
                if depth < 5 and rng.random() < 0.6:
                    tag = rng.choice(["div", "section", "div class='a b'", "div class=c"])
                    out += f"<{tag}>{grow((*path, tag), depth + 1)}</{tag.split()[0]}>"
                else:
                    tag, text, link = rng.choice(["p", "h2"]), " ".join(rng.choice(["one,", "two", "three."]) for _ in range(rng.randint(1, 9))), rng.random() < 0.3
                    s = want.setdefault((*path, tag), [0, 0, 0])
                    s[0] += 1
                    s[1] += 0 if link else len(text)
                    s[2] += 0 if link else text.count(",") + text.count(".")
                    out += f"<{tag}><a href=x>{text}</a></{tag}>" if link else f"<{tag}>{text}</{tag}>"
            return out

        page = html_text.read_page(f"<body>{grow((), 0)}</body>")
        assert sorted(html_text.path_ratios(page).values()) == sorted((c, m) for _, c, m in want.values())


ARTICLES = ["<article>", "<div class=post>"]


@pytest.mark.parametrize("opening", ARTICLES)
def test_short_blocks_of_the_article_stay(opening):
    body = f"<p>{SENTENCE}</p>" * 2
    for inner, want in (
        (f"{body}<table><tr><td>Name</td><td>12</td></tr></table><p>{SENTENCE}</p>", [SENTENCE, SENTENCE, "Name", "12", SENTENCE]),
        (f"{body}<p>{SENTENCE}</p><ul><li>Short item</li><li>Other</li></ul><pre>x</pre>", [SENTENCE] * 3 + ["Short item", "Other", "x"]),
        (f"<h2>Start</h2>{body}{body}<div class=share-buttons>Share it.</div><div class=ad>Buy now, cheap. Do it.</div><p>End.</p>", ["Start", *[SENTENCE] * 4, "End."]),
    ):
        close = "</article>" if opening == "<article>" else "</div>"
        page = f"<body><nav><ul><li><a href=/>Home</a></ul></nav><div class=ad>Buy now, cheap. Do it, today!</div>{opening}{inner}{close}<footer>Copyright, all rights reserved.</footer>"
        assert html_text.main_text(page).split("\n\n") == want


@pytest.mark.parametrize(("own", "theirs"), [(1, 3), (2, 6), (6, 20), (30, 90)])
def test_comments_longer_than_the_article(own, theirs):
    for opening in ("<section id=comments>", "<div class='comment-list'>", "<ol class=commentlist>"):
        page = f"<body><article>{f'<p>{SENTENCE}</p>' * own}{opening}{f'<div><p>Great post. {SENTENCE}</p></div>' * theirs}</section></div></ol></article>"
        assert html_text.main_text(page) == "\n\n".join([SENTENCE] * own)


def test_ratios_alone_remove_what_surrounds_an_article():
    """Same tags and classes without meaning everywhere: only path sums, smoothing and threshold can tell."""
    for size in (4, 9, 40):
        page = (
            "<body><div class=a><ul>" + "<li><a href=/>Home page</a></li>" * 8 + "</ul></div><div class=b>Buy now, cheap. Do it, today!</div>"
            f"<div class=c><h1>Title of it</h1>{f'<p>{SENTENCE}</p>' * size}<p>End.</p></div><div class=d>Some of it. <a href=x>{SENTENCE}</a></div><div class=e>Copyright, all rights reserved. Read the terms.</div>"
        )
        for names in (True, False):
            assert html_text.main_text(page, names=names).split("\n\n") == ["Title of it", *[SENTENCE] * size, "End."]


def test_names_change_few_pages():
    """Pages of the test data: names matter on at most 8 % of all, and on 2 % of those whose ratios are evidence."""
    import duckdb

    pages = [html_text.read_page(h) for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()]
    differ = [html_text.content_nodes(p) != html_text.content_nodes(p, names=False) for p in pages]
    evident = [max((c for c, _ in html_text.path_ratios(p).values()), default=0) >= html_text.EVIDENCE for p in pages]
    assert sum(differ) <= 0.08 * len(pages) and sum(d and e for d, e in zip(differ, evident, strict=True)) <= 0.02 * sum(evident) and sum(evident) > 0.9 * len(pages)
    for p in pages:  # what stands in the article, and nothing else
        own = html_text._below(p, 0, p.article)
        assert html_text.content_nodes(p) == [i for i, e in enumerate(p.inside) if own[e]]


def slow_quality(text, min_span):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]

    def span(size):
        c = Counter(tuple(w[i : i + size]) for i in range(n - size + 1))
        return [i for i in range(n - size + 1) if c[tuple(w[i : i + size])] > 1]

    longest, places = 0, set()
    while longest + 1 <= n and (found := span(longest + 1)):
        longest += 1
        if longest >= min_span:
            places |= {p for i in found for p in range(i, i + longest)}
    again = {p for i in span(8) for p in range(i, i + 8)} if n >= 8 else set()
    return n, sum(map(len, w)), sum((text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(places), longest


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ç#", "\n", "a b a b", "\x1c", "x\xa0y"]), max_size=40))
def test_repetition(parts):
    text = " ".join(parts)
    assert repetition.measure(text, 3) == slow_quality(text, 3)


def test_quality(spark):
    unique = " ".join(f"w{i}" for i in range(300))
    passage = " ".join(f"p{i}" for i in range(120))
    texts = [None, "", unique, "same words again " * 50, unique + " " + passage + " " + unique[:5] + " " + passage, " ".join(f"u{i}" for i in range(19)), "k " * 200_000]
    got = {r.doc_id: r for r in repetition.quality(table(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert [got[i].base_failed for i in range(7)] == [True, True, False, True, True, True, True]
    assert [got[i].kept for i in range(7)] == [False, False, True, False, False, False, False]
    assert got[4].longest_repeat == 120 and got[6].n_words == 200_000


def test_quality_verdict(spark):
    """``kept`` against brute force, with documents that only the method rejects."""
    short = [" ".join(f"s{j}" for j in range(k, k + 6)) for k in range(0, 60, 6)]
    texts = [" ".join(rng.choice([*short, f"w{rng.randrange(10**6)}", " ".join(f"n{rng.randrange(10**6)}" for _ in range(9))]) for _ in range(rng.randint(3, 40))) for _ in range(150)]
    passage = " ".join(f"p{i}" for i in range(70))
    texts += [" ".join([passage, *(f"x{i}" for i in range(500)), passage]), " ".join(f"y{i}" for i in range(400))]
    got = {r.doc_id: r for r in repetition.quality(table(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    alone = 0
    for i, t in enumerate(texts):
        n, _, _, _, again, covered, longest = slow_quality(t, 5)
        base = n < 20 or 100 * again > 30 * n
        fine = covered <= 0.3 * n and longest <= max(50, 0.1 * n)
        assert (got[i].base_failed, got[i].kept) == (base, not base and fine)
        alone += not base and not fine
    assert alone > 5 and not got[150].kept and got[151].kept
    assert repetition.quality(table(spark, [(1, "x", None)]).limit(0)).count() == 0
