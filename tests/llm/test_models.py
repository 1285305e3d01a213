"""Tokenizer, language model, page extraction and surrogates: round trips, brute force, held-out accuracy, edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from canopy.llm import _chunks, bpe, extract, lm, surrogates
from tests.conftest import DATA


def test_packing_round_trips():
    r = np.random.default_rng(0)
    for top in (1, 200, 70_000, 2**30):
        x = r.integers(0, top, 1000)
        assert (_chunks.unpack(_chunks.pack(x)) == x).all()
    assert _chunks.unpack(_chunks.pack(np.zeros(0, int))).size == 0
    words = [b"", b"a", "é".encode(), b"\n" * 300]
    assert _chunks.unpack_words(_chunks.pack_words(words)) == words and _chunks.unpack_words(_chunks.pack_words([])) == []


TEXTS = ["Hello world, hello!", "", None, "  spaces   and\n\nlines\t", "naïve Straße 12345 it's we'll", "日本語のテキスト 🎉🎉", "a" * 5000, "x\r\ny  z", "hello world"]


def test_bpe_equals_the_library(spark):
    ranks = bpe.load_ranks()
    library = tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (0, TEXTS[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("c"), "ids": F.lit(1), "row": F.lit(2), "chunk": F.lit(3), "decoded": F.lit(4)})
    found = bpe.decode(bpe.encode(docs, ranks, chunk_bytes=40), ranks).collect()
    assert len(found) == len(rows)
    want = {i: library.encode_ordinary(t or "") for i, t in rows}
    for r in found:
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]]
        assert bytes(r["decoded"]) == (dict(rows)[r["doc_id"]] or "").encode()
    report = {r["doc_id"]: r for r in bpe.round_trip_report(docs).collect()}
    assert report[1]["n_tokens"] == 0 and report[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.round_trip_report(docs.limit(0)).count() == 0


def test_network_gradients_match_differences():
    net = lm.Network(np.repeat(np.arange(lm.FREQUENT // lm.CLASS_SIZE), lm.CLASS_SIZE))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(1)
    inputs, targets = r.integers(0, lm.FREQUENT + lm.RARE, (5, 3)), r.integers(0, lm.FREQUENT + lm.RARE, (5, 3))
    mask = np.ones((5, 3), bool)

    def loss():
        states = net.states(inputs, np.zeros((3, lm.HIDDEN))).astype(np.float64)
        return -net.log10_of(states.reshape(-1, lm.HIDDEN), targets.ravel(), np.zeros(15)).mean() * math.log(10)

    grads, _ = net.gradients(inputs, targets, mask, np.zeros((3, lm.HIDDEN)))
    for name, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-2
        up = loss()
        net.p[name][at] = keep - 1e-2
        down = loss()
        net.p[name][at] = keep
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.03, abs=2e-4), name


def test_probabilities_sum_to_one():
    net = lm.Network(np.repeat(np.arange(lm.FREQUENT // lm.CLASS_SIZE), lm.CLASS_SIZE))
    n = lm.FREQUENT + lm.RARE
    state = np.random.default_rng(0).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    total = (10 ** net.log10_of(np.repeat(state, n, 0), np.arange(n), np.zeros(n))).sum()
    assert total == pytest.approx(1.0, abs=1e-4)


def test_lanes_and_windows_do_not_change_a_score():
    r = np.random.default_rng(2)
    texts = [np.append(r.integers(0, lm.FREQUENT + lm.RARE, n), 0) for n in (0, 5, 70, 130, 64, 63, 1)]
    zeros = [np.zeros(len(t)) for t in texts]
    net = lm.train(texts, epochs=1)
    alone = [lm.document_scores(net, [t], [z], lanes=1, window=1000)[0] for t, z in zip(texts, zeros, strict=True)]
    for lanes, window in ((1, 64), (3, 7), (256, 64)):
        assert lm.document_scores(net, texts, zeros, lanes, window) == pytest.approx(alone, rel=1e-4)


def test_symbols_are_projected_once_however_many_documents_begin():
    """What every symbol adds to the gates is worked out once for all documents that are scored together."""
    products = []

    class Counted(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, **more):
            products.extend([ufunc] * (ufunc is np.matmul))
            return getattr(ufunc, method)(*[x.view(np.ndarray) if isinstance(x, Counted) else x for x in inputs], **more)

    r = np.random.default_rng(4)
    net = lm.Network(np.repeat(np.arange(lm.FREQUENT // lm.CLASS_SIZE), lm.CLASS_SIZE))
    texts = [np.append(r.integers(0, lm.FREQUENT + lm.RARE, n), 0) for n in r.integers(0, 40, 100)]
    zeros = [np.zeros(len(t)) for t in texts]
    plain = lm.document_scores(net, texts, zeros, 8, 16)
    net.p["embed"] = net.p["embed"].view(Counted)
    assert lm.document_scores(net, texts, zeros, 8, 16) == pytest.approx(plain)
    assert len(products) == 1


def test_high_scores_stay_finite():
    powers, total = lm._powers(np.array([[200, 0], [1, 2]], np.float32))
    assert np.isfinite(powers).all() and total.tolist() == pytest.approx([math.exp(60) + 1, math.exp(1) + math.exp(2)], rel=1e-5)
    net = lm.Network(np.repeat(np.arange(lm.FREQUENT // lm.CLASS_SIZE), lm.CLASS_SIZE))
    targets = np.arange(6).reshape(3, 2)
    grads, _ = net.gradients(targets, targets, np.zeros((3, 2), bool), np.zeros((2, lm.HIDDEN), np.float32))
    assert not any(g.any() for g in grads.values())


def test_lm_base_and_model(spark):
    r = np.random.default_rng(3)
    rows = []
    for k in range(120):
        own = [f"{'abcd'[k % 4]}{j}" for j in range(30)]
        rows.append((k, " ".join(r.choice(own, 40)).title()))
    rows += [(200, None), (201, ""), (None, "null id"), (0, rows[0][1]), (202, "long " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "held_out": F.lit("c"), "training": F.lit(0), "row": F.lit(2), "bucket": F.lit(3)})
    found = lm.score(docs).collect()
    words = {n: re.findall("[^\x20\x09-\x0d]+", (t or "").lower()) + ["\n"] for n, (_, t) in enumerate(rows)}
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for n, (i, _) in enumerate(rows) if not held[i] for w in words[n])
    total, types = sum(c.values()), len(c)
    want = {(i, len(words[n])): sum(math.log10((c[w] + 1) / (total + types + 1)) for w in words[n]) for n, (i, _) in enumerate(rows)}
    assert len(found) == len(rows)
    for x in found:
        assert x["held_out"] == held[x["doc_id"]] and x["train_tokens"] == total
        assert x["base_score"] == pytest.approx(want[x["doc_id"], x["n_tokens"]], rel=1e-9)
        assert math.isfinite(x["score"]) and x["score"] < 0
    apart = [x for x in found if x["held_out"] and x["n_tokens"] > 5]
    assert apart and sum(x["score"] for x in apart) > sum(x["base_score"] for x in apart)
    assert lm.score(docs.limit(0)).count() == 0


def test_blocks_of_untidy_pages():
    page = "<html><head><title>T</title><script>if (a<b) '</p>'</script></head><body><p>one <b>two<br>three<p>four &amp; &#233;<!-- x <p> --> five<ul><li>a<li>b</ul><div class='ad big'>buy"
    got = [(b.text, b.tags[-1]) for b in extract.leaf_blocks(page)]
    assert [t for t, _ in got] == ["one two three", "four & é five", "a", "b", "buy"]
    assert extract.leaf_blocks(page)[-1].names == ("ad", "big")
    assert extract.leaf_blocks(None) == extract.leaf_blocks("") == extract.leaf_blocks("<!-- never closed <p>x") == extract.leaf_blocks("<script>open") == []
    assert [b.text for b in extract.leaf_blocks("1 < 2 and <3 <p title='a>b'>x</p")] == ["1 < 2 and <3", "x"]
    assert len(extract.leaf_blocks("<div>" * 3000 + "deep")) == 1


def test_chain_on_held_out_pages():
    chain = extract.trained_chain()
    wrong = total = 0
    for page, texts in extract.labelled_pages(80, seed=1234):
        blocks = extract.leaf_blocks(page)
        gold = extract.labels_for(blocks, texts)
        assert gold.sum() == len(texts)
        wrong += int((chain.decode(extract.features(blocks)) != gold).sum())
        total += len(blocks)
    assert wrong / total < 0.01


# Layouts that the training pages do not have: (page, with A for each article block and X for what surrounds it).
LAYOUTS = [
    "<body><div id=wrap><div class=kopf><a href=/>X</a></div><div class=artikel><h1>A</h1><p>A</p><p>A</p><p>A</p></div><div class=rechts><h4>X</h4><ul><li><a href=/1>X</a><li><a href=/2>X</a></ul></div><div class=fuss>&copy; X</div></div></body>",
    "<body><center><table width=800><tr><td colspan=2><font size=5>X</font></td></tr><tr><td width=150><a href=a>X</a><br><a href=b>X</a><br><a href=c>X</a></td><td><p>A<p>A<p>A</td></tr><tr><td colspan=2>&copy; X</td></tr></table></center></body>",
    "<body><section id=top-bar><a href=/>X</a> <a href=/in>X</a></section><main><section><h2>A</h2><p>A</p></section><section><h2>A</h2><p>A</p><p>A</p></section></main><section class=footer-wrap><p>&copy; X</p></section></body>",
    "<article><header><h1>A</h1></header><p>A</p><figure><img src=i><figcaption>A</figcaption></figure><p>A</p></article>",
    "<html><body><div><p>A</p><p>A</p></div></body></html>",
    "<article><p>A</p></article>",
    "<body><ul class=crumbs><li><a href=1>X</a><li><a href=2>X</a><li><a href=3>X</a></ul><div class=c1><div class=c2><div class=c3><h1>A</h1><p>A</p><ul><li>A</li><li>A</li></ul><p>A</p></div></div></div><div class=cookie-banner>X</div></body>",
    "<body><div role=navigation><a href=1>X</a><a href=2>X</a><a href=3>X</a></div><div itemprop=articleBody><p>A</p><blockquote>A</blockquote><p>A</p></div><div id=comments><div class=comment><p>X</p></div><div class=comment><p>X</p></div></div></body>",
    "<body><form action=/s><input name=q><button>X</button></form><h1>A</h1><p>A</p><p>A</p><p>A</p><div class=related-posts><a href=1>X</a><a href=2>X</a></div><footer><p>X</p><p><a href=i>X</a></p></footer></body>",
    "<body><div class=grid><div class=col><nav><a href=1>X</a><a href=2>X</a></nav></div><div class=col><h1>A</h1><p>A</p><p>A</p><div class=ad-slot>X</div><p>A</p></div><div class=col><aside><h3>X</h3><a href=3>X</a></aside></div></div></body>",
]


def test_chain_on_layouts_it_was_not_trained_on():
    r = random.Random(12)
    vocabulary = "Haus Weg river stone light lumière jardin casa noche under über between walks sings grows old new three".split()

    def fill(mark, before):
        words = [r.choice(vocabulary) for _ in range(r.randint(12, 50) if mark == "A" else r.randint(1, 5))]
        if mark == "A" and before.endswith(("<h1>", "<h2>", "<figcaption>")):
            words = words[:6]
            return f"own{r.randrange(10**9)} " + " ".join(words)
        return f"own{r.randrange(10**9)} " + " ".join(words).capitalize() + ("." if mark == "A" else "")

    chain, right, wrong, missed = extract.trained_chain(), 0, 0, 0
    for layout in LAYOUTS:
        for _ in range(6):
            page, want, at = "", [], 0
            for m in re.finditer(r"(?<=[> ])[AX](?=<)", layout):
                text = fill(m[0], layout[: m.start()])
                page += layout[at : m.start()] + text
                at = m.end()
                want += [text] if m[0] == "A" else []
            got = extract.main_text(page + layout[at:], chain).split("\n")
            right, wrong, missed = right + len(set(got) & set(want)), wrong + len(set(got) - set(want)), missed + len(set(want) - set(got))
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.95, (right, wrong, missed)


def test_viterbi_equals_enumeration():
    r = np.random.default_rng(0)
    chain = extract.Chain(r.standard_normal((len(extract.FEATURES), 2)), r.standard_normal((2, 2)))
    x = r.standard_normal((7, len(extract.FEATURES)))
    s = x @ chain.emission
    best = max(range(2**7), key=lambda m: sum(s[t, m >> t & 1] for t in range(7)) + sum(chain.transition[m >> t & 1, m >> t + 1 & 1] for t in range(6)))
    assert chain.decode(x).tolist() == [best >> t & 1 for t in range(7)]


def test_extraction(spark):
    page = "<body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><article><h1>A  title</h1><p>First, a long\n sentence of the article.</p><p>More &lt;text&gt; here, as it goes on.</p></article><footer>&copy; me</footer>"
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (1, "u", page), (4, "w", "<article><p>" + "long words, here. " * 20_000 + "</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("c")})
    found = {(x["page_id"], x["n_chars"]): x["text"] for x in extract.extraction_report(pages).collect()}
    want = "A title\nFirst, a long sentence of the article.\nMore <text> here, as it goes on."
    assert found[1, len(want)] == want and found[2, 0] == "" and found[None, 0] == "" and found[4, 359_999]
    assert extract.extraction_report(pages.limit(0)).count() == 0


PRIVATE = "Mail Ann.Lee@site.org or ann.lee@site.org, call +1 (212) 555-0187 or 12125550187x, pay 4111 1111 1111 1111 not 4111111111111112, from 10.20.30.40, ssn 123-45-6789."


def _luhn(digits):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_surrogates(spark):
    rows = [
        (1, PRIVATE), (2, "again ann.lee@site.org and 10.20.30.40 and (212) 555-0187"), (3, None), (4, ""), (5, "nothing here"), (None, "null id 10.20.30.40"), (1, PRIVATE),
        (6, "Mr. John Smith met Mrs. Anna Smith. Herr Smith left."), (7, "господин Иван Петров"), (8, "v 1.2.3.4.5 and 999.1.1.1 and 1234"), (9, "x " * 50_000 + "10.20.30.41"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "row": F.lit(2), "found": F.lit(3), "digest": F.lit(4), "swap": F.lit(5), "n_entities": F.lit("c")})
    found = surrogates.replace_entities(docs, "key").collect()
    assert len(found) == len(rows)
    out = {x["doc_id"]: (x["text"], x["n_entities"]) for x in found}
    text, n = out[1]
    for real in ("Ann.Lee@site.org", "ann.lee@site.org", "555-0187", "4111 1111 1111 1111", "10.20.30.40", "123-45-6789"):
        assert real not in text
    assert "4111111111111112" in text and "12125550187x" in text and n == 6
    card = re.search(r"pay (\d{4} \d{4} \d{4} \d{4}) ", text)[1]
    assert _luhn(card.replace(" ", "")) and card[0] == "4" and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} ", text) and re.search(r"ssn \d{3}-\d{2}-\d{4}\.", text)
    mails, address = re.findall(r"\S+@\S+\.org", text), re.search(r"from (\S+), ssn", text)[1]
    assert mails[0] == mails[1] and mails[0] in out[2][0] and address in out[2][0] and address in out[None][0]
    assert out[3] == (None, 0) and out[4] == ("", 0) and out[5] == ("nothing here", 0) and out[8][1] == 0 and out[9][1] == 1
    names = re.match(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. Herr (\w+) left\.", out[6][0])
    assert names[2] == names[4] == names[5] != "Smith" and names[1] != names[3] and names[1].endswith("n") and names[3].endswith("la")
    assert re.fullmatch(r"господин [А-я]+н [А-я]+", out[7][0]) and "Петров" not in out[7][0]
    assert {x["text"] for x in surrogates.replace_entities(docs, "other").collect()} != {x["text"] for x in found}
    assert surrogates.replace_entities(docs.limit(0), "key").count() == 0


def test_surrogates_stay_distinct_when_draws_clash(spark):
    keys = [f"1{k:02d}" for k in range(100)]  # every number of the format is a real one
    units = spark.createDataFrame([("ssn", k, "") for k in keys], "kind string, key string, gender string")
    for rounds in (2, 10):
        drawn = {x["key"]: x["drawn"] for x in surrogates.assign(units, "key", rounds=rounds).collect()}
        assert sorted(drawn) == keys and len(set(drawn.values())) == 100 and not set(drawn.values()) & set(keys)


def test_short_addresses_stay_distinct(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k, f"mail {a}@{b}.co") for k, (a, b) in enumerate((a, b) for a in letters for b in letters)]
    found = [x["text"] for x in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()]
    assert len(set(found)) == 676 and not set(found) & {t for _, t in rows}
    assert all(re.fullmatch(r"mail [a-z]+@[a-z]\.co", t) for t in found)


def _iban_ok(account):
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def test_one_surrogate_for_one_person_phone_and_address(spark):
    rows = [
        (1, "Mr John Smith came. Dr John Smith spoke, and John Smith's friend; JOHN left, Smithson stayed."), (2, "Prof. John Smith"), (3, "call +1 (212) 555-0187 or (212) 555-0187"),
        (4, "from fe80::1a2 to FE80:0:0:0:0:0:0:01a2, at 12:30:45, a::b"), (5, "pay DE89 3704 0044 0532 0130 00, or DE89370400440532013000, not DE88370400440532013000"), (6, "John Smith without a form of address"),
    ]
    out = {x["doc_id"]: (x["text"], x["n_entities"]) for x in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    name = re.fullmatch(r"Mr (\w+) (\w+) came\. Dr (\w+) (\w+) spoke, and (\w+) (\w+)'s friend; (\w+) left, Smithson stayed\.", out[1][0])
    assert name[1] == name[3] == name[5] == name[7].title() != "John" and name[2] == name[4] == name[6] != "Smith" and out[1][1] == 5 and name[1].endswith("n")
    assert out[2][0] == f"Prof. {name[1]} {name[2]}" and out[6] == (rows[5][1], 0)
    phone = re.fullmatch(r"call \+1 (\(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4})", out[3][0])
    assert phone[1] == phone[2] != "(212) 555-0187"
    address = re.fullmatch(r"from (\S+) to (\S+), at 12:30:45, a::b", out[4][0])
    assert address[1] == address[2] and address[1].count(":") == 7
    account = re.fullmatch(r"pay (DE\d\d(?: \d{4}){4} \d\d), or (DE\d{20}), not DE88370400440532013000", out[5][0])
    assert account[1].replace(" ", "") == account[2] != "DE89370400440532013000" and _iban_ok(account[2])


def test_surrogates_of_planted_entities(spark, monkeypatch):
    """Against templates whose entities are known: all of them go, nothing else changes, and entities map one to one."""
    monkeypatch.setattr(surrogates, "HOT", 5)
    r = random.Random(4)
    digits = lambda n: "".join(r.choices("0123456789", k=n))

    def card():
        body = "4" + digits(14)
        return body + next(d for d in "0123456789" if _luhn(body + d))

    make = {
        "email": (lambda: f"{r.choice('abc')}{digits(2)}@{r.choice('xyz')}.org", r"[a-z]+\d*@[a-z]+\.org", lambda s: True), "ip": (lambda: f"10.{r.randint(0, 9)}.7.{r.randint(0, 9)}", r"\d+(?:\.\d+){3}", lambda s: True),
        "card": (card, r"4\d{15}", _luhn), "ssn": (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", r"\d{3}-\d{2}-\d{4}", lambda s: True), "secret": (lambda: "a1" + "".join(r.choices("0123456789abcdef", k=38)), "[0-9a-f]{40}", lambda s: True),
        "phone": (lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", r"\(\d{3}\) \d{3}-\d{4}", lambda s: True), "name": (lambda: f"Frau {r.choice(['Ada', 'Eva'])} {r.choice(['Holm', 'Lund', 'Berg'])}", r"Frau \w+la \w+r", lambda s: True),
    }
    pool = {k: [f() for _ in range(6)] for k, (f, _, _) in make.items()}
    rows, shapes = [], {}
    for k in range(80):
        kinds = r.choices(list(make), k=r.randint(0, 6))
        own = [r.choice(pool[x]) for x in kinds]
        rows.append((k, "start " + " und ".join(own) + " end"))
        shapes[k] = (kinds, own, "start " + " und ".join(f"({make[x][1]})" for x in kinds) + " end")
    new = {}
    for x in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect():
        kinds, own, shape = shapes[x["doc_id"]]
        match = re.fullmatch(shape, x["text"])
        assert match and x["n_entities"] == len(own), (x, shape)
        for kind, real, drawn in zip(kinds, own, match.groups(), strict=True):
            assert new.setdefault(real, drawn) == drawn and make[kind][2](drawn), (kind, real, drawn)
    assert len(set(new.values())) == len(new) and not set(new.values()) & set(new)


def test_surrogate_plan_is_native(spark):
    docs = spark.createDataFrame([(1, PRIVATE)], "doc_id long, text string")
    plan = surrogates.replace_entities(docs, "key")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_lm_rounds_train_on_every_document_once(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(k, " ".join(r.choice([f"a{j}" for j in range(20)], 40))) for k in range(60)] + [(1000 + k, " ".join(["odd", "even"] * 20)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    taught, nets, averaged = [], [], lm._averaged

    def watched(symbols, start, buckets, rate, lanes):
        taught.extend(x["id"] for x in symbols.select("id").collect())
        nets.append(averaged(symbols, start, 3, rate, lanes))
        return nets[-1]

    monkeypatch.setattr(lm, "_averaged", watched)
    found = {x["doc_id"]: x["score"] for x in lm.score(docs).collect()}
    assert sorted(taught) == [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    assert len(nets) == len(lm.ROUNDS) and all(np.isfinite(v).all() for net in nets for v in net.p.values()) and all(math.isfinite(x) for x in found.values())
    symbols, zero = [np.array([1, 2] * 20 + [0])], [np.zeros(41)]
    assert lm.document_scores(nets[-1], symbols, zero)[0] > lm.document_scores(nets[0], symbols, zero)[0]


def test_training_state_ends_with_its_document():
    """A window in which documents begin gives the gradients of the documents apart."""
    net = lm.Network(np.repeat(np.arange(lm.FREQUENT // lm.CLASS_SIZE), lm.CLASS_SIZE))
    r = np.random.default_rng(1)
    inputs, targets, mask = r.integers(0, lm.FREQUENT, (9, 1)), r.integers(0, lm.FREQUENT, (9, 1)), np.ones((9, 1), bool)
    begins = np.zeros((9, 1), bool)
    begins[[0, 4]] = True
    whole, last = net.gradients(inputs, targets, mask, np.ones((1, lm.HIDDEN), np.float32), begins)
    zero = np.zeros((1, lm.HIDDEN), np.float32)
    one, _ = net.gradients(inputs[:4], targets[:4], mask[:4], zero)
    two, end = net.gradients(inputs[4:], targets[4:], mask[4:], zero)
    assert np.allclose(last, end)
    for k, g in whole.items():
        assert np.allclose(9 * g, 4 * one[k] + 5 * two[k], atol=1e-5), k


def test_lm_beats_counts_on_held_out_documents(spark):
    """By a quarter of a decade a token, on the corpus."""
    found = lm.score(spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/documents.parquet")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert (found["s"] - found["b"]) / found["n"] > 0.25, found


def test_lm_co_occurrence_counts_texts():
    texts = [np.array([3, 5, 5, 0]), np.array([3, 0]), np.array([lm.FREQUENT + 1, 5, 0])]
    together = lm.co_occurrence(texts, at_once=2)
    assert (together[3, 3], together[3, 5], together[5, 5], together[0, 0], together[0, 5]) == (2, 1, 2, 3, 2)
