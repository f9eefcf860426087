"""Chat formatting, page extraction, packing, toxicity and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from calorix.llm import packing, page_text, toxicity
from calorix.llm.chat_format import digests, format_conversations, op1_chat_format, read_back
from calorix.llm.packing import PackRules, pack_documents, pack_shard, public_vocabulary
from calorix.llm.page_text import common_lines, extract_pages, page_lines
from tests.llm.data import documents, empty, texts, words

TURNS = "conv_id long, turn long, role string, text string, part int, seq string"
NASTY = [
    "", None, "\\", "\\\\[INST]", "[/INST]", "</s>", "<\\/s>", "[\\INST]", "</s>[INST] ok [/INST]", "\n", "é🙂",
    "[INST[INST]]", "\\" * 7 + "</s>", "x" * 200_000,
]


def conversation_rows():
    draw = random.Random(1)
    rows = []
    for c in range(12):
        for t in range(draw.randrange(1, 9)):
            rows.append((c, t, draw.choice(["user", "assistant", None, "[INST]</s>"]), draw.choice(NASTY), 1, "x"))
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t}", 1, "x") for t in range(3000)]
    rows += [(None, 0, "user", "nobody", 1, "x"), (50, None, "user", "first", 1, "x"), (50, 0, "assistant", "b", 1, "x")]
    return rows


def test_conversations(spark):
    rows = conversation_rows()
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    pieces = format_conversations(turns)
    found = {r.conv_id: r for r in digests(pieces).collect()}
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        groups.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(found) == set(groups)
    for conv, told in groups.items():
        r = found[conv]
        whole = "".join(f"{role}\n{text}\n" for role, text in told)
        loss = "".join(text for role, text in told if role == "assistant")
        assert r.n_turns == len(told)
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in pieces.collect():
        assert len(read_back(r.formatted)) == r.n_turns
    assert digests(format_conversations(turns.limit(0))).count() == 0


def test_control_strings(spark, folder):
    r = op1_chat_format(spark, folder).where("conv_id = -7").first()
    told = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars) == (2, len(told))
    assert r.loss_sha256 == hashlib.sha256(told.encode()).hexdigest()


PAGES = [
    ("<body><nav>Home</nav><article><h1>T &amp; Q</h1><p>One  two<br>three<p>Four <b>bold</b>er</article><footer>f</footer>", "T & Q One two three Four bolder"),
    ("<article><p>Text</p><div class='ad-box'>Buy</div><form>Name <input></form><section id=comments><p>hi</p></section><p>End</p></article>", "Text End"),
    ("<main><p>a &lt;b&gt; &eacute; &#x41;</p><script>if(a<b){'</p>'}</script><style>p{}</style><!-- <p>no</p> --><ul><li>x<li>y</ul></main>", "a <b> é A x y"),
    ("<div class=sidebar><p>s</p></div><p>No article</p><div class='cookie notice'>ok</div><p>here</p>", "No article here"),
    ("<article><header><h1>Title</h1></header><p>cut off &am", "Title cut off &am"),
    ("<header><p>site</p></header><article><aside><p>x</p></aside><p title='a > b'>q</p><noscript>n</noscript></article>", "q"),
    (None, ""), ("", ""), ("plain < text", "plain < text"), ("<p>" * 3000 + "deep", "deep"), ("<article></article>", ""),
]


def test_ids_beside_null(spark):
    """Large ids keep all their digits in a batch that also holds null ones."""
    ids = [2**60 + 1, None, 2**60 + 3]
    turns = [(i, t, "user", f"text {i}") for i in ids for t in (0, 1)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1)
    found = {r.conv_id: r for r in digests(format_conversations(frame)).collect()}
    assert set(found) == set(ids)
    for i, r in found.items():
        want = "".join(f"user\ntext {i}\n" for _ in (0, 1))
        assert r.n_turns == 2 and r.turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    pages = [(i, f"http://h/{k}", f"<article><p>page {i}</p></article>") for k, i in enumerate(ids)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    assert {r.page_id: r.text for r in extract_pages(frame).collect()} == {i: f"page {i}" for i in ids}
    named = frame.withColumn("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")))
    assert {r.page_id for r in extract_pages(named).collect()} == {f"p{ids[0]}", None, f"p{ids[2]}"}


def test_pages(spark):
    rows = [(k, f"http://h{k}.com/", p, "clash") for k, (p, _) in enumerate(PAGES)] + [(90, None, "<p>x", "c"), (90, None, "<p>x", "c")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, _host string")
    found = extract_pages(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        expected = "x" if r.page_id == 90 else PAGES[r.page_id][1]
        assert (r.text, r.n_chars) == (expected, len(expected)), r.page_id
    assert extract_pages(docs.limit(0)).count() == 0


def test_template_lines_go(spark):
    """Lines outside paragraphs that near urls share are the template's; quoted paragraphs stay."""
    page = "<div>Welcome to the site</div><div>{}</div><div>{}</div><div>All rights reserved</div>"
    rows = [(k, f"http://a.org/{k:02}", page.format(" ".join(words(k, 30)), " ".join(words(-k, 30)))) for k in range(1, 9)]
    quote = "<article><p>{}</p><p>a shared quote</p><div>Share this</div></article>"
    rows += [(k, f"http://b.org/{k}", quote.format(" ".join(words(k, 30)))) for k in range(20, 24)]
    rows += [(k, f"http://c.org/{k}", "<div>same</div><div>page</div>") for k in range(30, 33)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = {r.page_id: r.text for r in extract_pages(docs.coalesce(1)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = {r.page_id: r.text for r in extract_pages(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k in range(1, 9):
        assert found[k] == " ".join(words(k, 30) + words(-k, 30))
    for k in range(20, 24):
        assert found[k] == " ".join(words(k, 30)) + " a shared quote"
    assert found[30] == "same page"


def test_common_lines():
    draw = random.Random(2)
    for _ in range(300):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = common_lines(a, b)
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(a[i] in rest for i in found)


def test_page_table(spark, folder):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = page_text.op6_html_extraction(spark, folder).collect()
    assert len(found) == len(html)
    for r in found:
        lines = [t for t, kind in page_lines(html[r.page_id]) if kind == 2]
        assert r.text == " ".join(lines)


def check_pieces(rows, pieces, window=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(public_vocabulary())
    want = {}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(i, []).append(ids)
    by_id, by_sequence = {}, {}
    for p in pieces:
        by_id.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_id) == set(want)
    for i, ids in want.items():
        total = sum(p.length for p in by_id[i])
        assert total == sum(map(len, ids))
        if len(ids) == 1:
            at = 0
            for p in sorted(by_id[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids[0])
                assert p.ids_crc32 == zlib.crc32(ids[0][at : at + p.length].tobytes())
                at += p.length
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or at < window and at & (at - 1) == 0


def test_packing(spark):
    odd = [
        (60, "<|endoftext|> <|STARTOFTEXT|>x It's 12ab... A.B?! it'S"), (61, "É\u0301 ÅNGSTRÖM ﬁ ΑΣ ΑΣ. İx"),
        (62, "a\x1cb\x85c\u2028d\u3000e"), (63, "x" * 5000 + ".,;"), (64, "=\u0338 <\u0338. a.\u0301b"),
    ]
    rows = texts() + odd
    docs = documents(spark, rows)
    check_pieces(rows, pack_documents(docs, public_vocabulary()).collect())
    check_pieces(rows, pack_documents(docs, public_vocabulary(), rules=PackRules(shard_bytes=20_000)).collect())
    assert pack_documents(empty(spark), public_vocabulary()).count() == 0


def test_packing_keeps_ids(spark):
    """Large ids beside null ones, and ids that are texts."""
    big = [(2**60 + 1, "one two"), (None, "three"), (2**60 + 3, "four"), (None, None)]
    schema = "doc_id long, text string"
    check_pieces(big, pack_documents(spark.createDataFrame(big, schema), public_vocabulary()).collect())
    named = [("a", "one two"), (None, "three"), ("b" * 40, "four")]
    out = pack_documents(spark.createDataFrame(named, "doc_id string, text string"), public_vocabulary())
    check_pieces(named, out.collect())


def test_word_ids_forget():
    """A task that may remember few words gives the same ids."""
    data = [" ".join(words(f"w{k}", 30)) + " X. <|A b" * (k % 3) for k in range(40)]
    raw = np.frombuffer("".join(data).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(x.encode()) for x in data])])
    whole, few = (packing.WordIds(public_vocabulary(), n) for n in (10_000, 50))
    ids, first = whole.of(raw, at)
    for k in range(40):
        some, _ = few.of(raw[at[k] : at[k + 1]], at[k : k + 2] - at[k])
        assert np.array_equal(some, ids[first[k] : first[k + 1]])
        assert some.tolist() == whole.tokenizer.encode(data[k], add_special_tokens=False).ids


def test_best_match_first():
    """Unused documents in falling order of their scores, also after used ones left the index."""
    draw = np.random.default_rng(5)
    docs = [draw.integers(0, 400, 30) for _ in range(300)]
    index, unused = packing.Neighbours(docs, PackRules()), np.ones(300, bool)
    for dropped in ([], range(0, 300, 3)):
        unused[list(dropped)] = False
        smaller = index.among(unused)
        for seed in (1, 50, 298):
            score = np.where(unused, index.scores(seed), 0)
            want = [d for d in np.argsort(-score, kind="stable").tolist() if score[d] > 0]
            assert list(index.of(seed, unused)) == want
            assert np.allclose(smaller.scores(seed), index.scores(seed)[unused])
            assert sorted(smaller.of(seed, unused)) == sorted(want)


def test_packing_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    check_pieces([tuple(r) for r in docs], packing.op8_packing(spark, folder).collect())


def test_neighbours_fill_the_window():
    """A seed is packed with the documents that share its words."""
    rules = PackRules(window=100)
    topics = [np.arange(t * 50, t * 50 + 25) for t in range(6)]
    docs = [topics[t] for t in range(6) for _ in range(4)]
    pieces = pack_shard(docs, rules)
    held = {}
    for d, _, length, sequence, _ in pieces:
        assert length == 25
        held.setdefault(sequence, set()).add(d // 4)
    assert all(len(x) == 1 for x in held.values())


def test_toxicity_edges(spark):
    rules = toxicity.MachineRules(bits=12)
    draw = random.Random(4)
    rows = []
    for k in range(900):
        w = words(k, draw.randrange(5, 60))
        toxic = k % 4 == 0
        # neither word alone says much, both together do
        if toxic:
            w[draw.randrange(len(w))] = "INSULT!"
            w.append("group,")
        elif k % 4 == 1:
            w[0] = "insult"
        elif k % 4 == 2:
            w[0] = "group"
        rows.append((k, " ".join(w)))
    labels = [(i, int(i % 4 == 0), "x") for i, _ in rows] + [(None, 1, "x"), (3, None, "x"), (5, 0, "x")]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    docs = documents(spark, rows)
    model = toxicity.fit_machine(docs, labels, rules=rules)
    scored = toxicity.score_texts(docs, model, rules=rules).withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    right = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in scored.where("held_out").collect()]
    assert len(right) > 100 and np.mean(right) > 0.95
    found = toxicity.score_texts(documents(spark), model, rules=rules).collect()
    assert len(found) == len(texts()) and all(0 <= r.score <= 1 for r in found)
    nothing = {r.score for r in found if r.doc_id in (0, 1, 2)}
    assert len(nothing) == 1
    assert toxicity.score_texts(empty(spark), model, rules=rules).count() == 0
    untaught = toxicity.fit_machine(docs, labels.limit(0), rules=rules)
    assert {r.score for r in toxicity.score_texts(docs, untaught, rules=rules).collect()} == {0.5}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = toxicity.op10_toxicity(spark, folder)
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    for r in rows:
        assert zlib.crc32(str(r.doc_id).encode()) % 5 == 0
    bad, good = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.95


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes, name
        assert 0.5 * docs.count() < out.count() <= docs.count(), name
        docs = corpus_pipeline.durable(out, f"test-{name}")
    assert docs.where("n_chars != length(text)").count() == 0
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check_pieces(rows, corpus_pipeline.run(spark, folder).collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, folder, name):
    """Nulls, empty and very long texts, repeated rows, clashing names, an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = documents(spark)
    out = stage(spark, docs, folder)
    if name == "packing":
        check_pieces(texts(), out.collect())
    else:
        assert out.columns == docs.columns
        assert 0 < out.count() <= len(texts())
    assert stage(spark, empty(spark), folder).count() == 0


def test_related_documents_share_a_shard(spark):
    """Groups of similar documents, dealt over many rows, are packed by the same shard."""
    rows = []
    for k in range(160):
        base = words(f"group{k % 40}", 60)
        rows.append((k, " ".join(base[k // 40 :] + words(k, 6))))
    pieces = pack_documents(documents(spark, rows), public_vocabulary(), rules=PackRules(shard_bytes=6_000)).collect()
    shards = {}
    for p in pieces:
        shards.setdefault(p.doc_id % 40, set()).add(p.sequence_id >> 32)
    assert len({s for held in shards.values() for s in held}) > 4
    assert sum(len(held) <= 2 for held in shards.values()) >= 32


def test_scores_of_all_terms():
    """BM25 over every shared term, with the counts of a corpus that is larger than the shard."""
    draw, rules = np.random.default_rng(4), PackRules()
    docs = [draw.integers(0, 300, n) for n in (5, 80, 200, 400, 90, 1)]
    corpus = packing.Corpus(1000, 150.0, draw.integers(6, 900, 300))
    found = packing.Neighbours(docs, rules, corpus)
    for seed, own in enumerate(docs):
        for other, held in enumerate(docs):
            if other == seed:
                continue
            expected = 0.0
            for t in set(own.tolist()) & set(held.tolist()):
                tf, df = (held == t).sum(), corpus.df[t]
                norm = rules.k1 * (1 - rules.b + rules.b * len(held) / 150)
                expected += np.log1p((1000 - df + 0.5) / (df + 0.5)) * tf * (rules.k1 + 1) / (tf + norm)
            assert abs(found.scores(seed)[other] - expected) < 1e-9
