"""Packing, models, chat, pages and urls against brute force, round trips and held-out rows."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstruct.llm import chat as C
from docstruct.llm import kneser_ney as K
from docstruct.llm import langid as H
from docstruct.llm import packing as B
from docstruct.llm import pages as P
from docstruct.llm import quality as Q
from docstruct.llm import urls as U

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Packing


def test_tokens_are_those_of_the_tokenizer(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text or "" for r in docs.collect()] + ["", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y<|endoftext", "  x\n\n\ty  ", "ÀÉ中文\U0001f600", " ", "'s don't I'LL 12345 \u00a0 z"]
    for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert B.tokenize(text, "byte_bpe_50k.tiktoken").tolist() == e.ids + [0]


def test_packing_is_whole_gapless_and_near_the_bound(spark, docs):
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "a b " * 9000), (9003, "a b " * 9000), (None, "x")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd)
    rows = B.pack_documents(docs).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(B.tokenize(r.text, "byte_bpe_50k.tiktoken"))
    assert len({r.doc_id for r in rows}) == len(texts)
    by_sequence, total, seen = defaultdict(list), 0, Counter()
    for r in rows:
        ids = texts[r.doc_id][0]
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes())
        seen[r.doc_id] += r.length
        total += r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert seen == Counter({d: sum(map(len, t)) for d, t in texts.items()})
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= B.CAPACITY
    assert len(by_sequence) <= math.ceil(total / B.CAPACITY) + 1


def test_exchange_rounds_place_every_piece_once(spark):
    rng = random.Random(4)
    lengths = [rng.choice([700, 1025, 1300, 3, 90, 2048]) for _ in range(600)]
    table = spark.createDataFrame(list(enumerate(lengths)), "u long, length long")
    rows = B.place_pieces(table, group=64).collect()
    assert sorted(r.u for r in rows) == list(range(600))
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += lengths[r.u]
    assert max(fill.values()) <= 2048 and B.lower_bound(np.array(lengths)) <= len(fill) <= len(set(B.best_fit(np.array(lengths)))) + 3


def test_bounds_hold_for_small_packings():
    rng = random.Random(1)

    def least(items, bins=()):
        if not items:
            return len(bins)
        first, rest = items[0], items[1:]
        options = {b for b in bins if b + first <= 10}
        out = least(rest, (*bins, first))
        for b in options:
            others = list(bins)
            others.remove(b)
            out = min(out, least(rest, (*others, b + first)))
        return out

    for _ in range(60):
        items = [rng.randint(1, 10) for _ in range(rng.randint(0, 7))]
        bins = B.best_fit(np.array(items, np.int64), 10)
        assert B.lower_bound(np.array(items), 10) <= least(items) <= len(set(bins.tolist()))


# Language identification


def test_language_of_held_out_rows(docs):
    rows = H.language_table(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    rows = [(0, "der die das und der Hund", "de"), (1, "the and of the dog", "en"), (3, None, "en"), (4, "12 ?", "xx"), (5, "", None), (6, "THE DOG", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = H.train(table.where("doc_id < 2"))
    got = {r.doc_id: r.p for r in table.select("doc_id", H.identify(table, made).alias("p")).collect()}
    assert [got[k].lang for k in (3, 4, 5)] == ["und"] * 3 and got[6].lang == "en" and got[0].lang == "de"
    assert {r.p.lang for r in table.select(H.identify(table, {}).alias("p")).collect()} == {"und"}
    assert H.language_table(table.where("false")).count() == 0


def test_gram_vectors_are_turned_products():
    a, b, c = (H.letter_vector(ord(x)) for x in "abc")
    vector = H.gram_vectors(np.array([[97, 98, 99]]))[0]
    assert (vector == np.roll(a, 2) * np.roll(b, 1) * c).all()
    for places, most in ((H.PLACES, H.GRAMS), (3, 2), (1, 1)):
        found = defaultdict(lambda: np.zeros(2, int))
        for grams, counts in H.gram_counts(["abab", "Ab! ab"], places=places, most=most):
            assert len(grams) <= most
            for k, g in enumerate(grams):
                found["".join(map(chr, g))] += counts[:, k].astype(int)
        assert {k: n.tolist() for k, n in found.items()} == {" ab": [1, 2], "aba": [1, 0], "bab": [1, 0], "ab ": [1, 2], "b a": [0, 1]}


def test_languages_against_brute_force(spark):
    """Letters of three scripts, counted gram by gram."""
    rng = random.Random(15)
    alphabets = {"aa": "abcdefgh \n", "bb": "абвгдежз, ", "cc": "".join(map(chr, range(0x4E00, 0x4E40))) + "。", "dd": "efghijkl 7"}
    rows = [(k, "".join(rng.choices(alphabets[name], k=rng.randrange(400))), name) for k, name in enumerate(sorted(alphabets) * 12)]
    rows += [(100, "AB ab", "aa"), (101, rows[0][1], "aa"), (102, "ǅ", None), (103, "Ab\u0301", None)]

    def grams(text):
        kept = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
        return Counter(kept[k : k + 3] for k in range(len(kept) - 2) if kept[k : k + 3].strip())

    def bundle(counts):
        total = np.zeros(H.DIMENSIONS)
        for g, n in counts.items():
            x, y, z = (H.letter_vector(ord(c)).astype(int) for c in g)
            total += n * np.roll(x, 2) * np.roll(y, 1) * z
        return total

    taught = defaultdict(Counter)
    for k, text, name in rows:
        if name and zlib.crc32(str(k).encode()) % 4 != 2:
            taught[name] += grams(text)
    prototypes = {name: bundle(c) for name, c in taught.items()}
    got = {r.doc_id: r for r in H.language_table(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    for k, text, _ in rows:
        v = bundle(grams(text))
        cosines = {n: float(v @ p / max(np.linalg.norm(v) * np.linalg.norm(p), 1e-9)) for n, p in prototypes.items()}
        if not any(c.isalpha() for c in text):
            assert (got[k].lang_pred, got[k].score) == ("und", 0)
            continue
        assert abs(cosines[got[k].lang_pred] - max(cosines.values())) < 1e-6
        assert abs(got[k].score - min(1, max(0, max(cosines.values())))) < 1e-5


def test_long_texts_of_many_letters_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(16)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 300_000)))
    tracemalloc.start()
    total = sum(H.gram_vectors(grams).astype(np.float32).T @ counts[0] for grams, counts in H.gram_counts([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(total) == H.DIMENSIONS and peak < 150e6


# Kneser-Ney


def test_kneser_ney_against_brute_force(spark):
    texts = ["abc abd. Abc", "abcabcabd", "the 12 cats!", "xyzzy xyz\nabc"]
    counts = Counter()
    for t in texts:
        grams, n = K.gram_counts(t)
        for g, k in zip(grams.tolist(), n.tolist()):
            counts[g // 4096, g // 64 % 64, g % 64] += k
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    nll = {r.gram: r.nll for r in K.train(K.count_corpus(table)).collect()}
    assert len(nll) == K.GRAMS
    for u, v in ((0, 0), (8, 9), (40, 41), (0, 34)):
        assert abs(sum(math.exp(-nll[(u * 64 + v) * 64 + w]) for w in range(64)) - 1) < 1e-9

    def discounts(table):
        t = [sum(n == k for n in table.values()) for k in range(5)]
        y = t[1] / max(1, t[1] + 2 * t[2])
        return [min(max(min(k - (k + 1) * y * t[k + 1] / max(1, t[k]), k - 0.1), 0.1), 99) for k in (1, 2, 3)]

    two, one = Counter((v, w) for _, v, w in counts), Counter()
    for _, w in two:
        one[w] += 1

    def level(table, context, w, below):
        d = discounts(table)
        mine = {k: n for k, n in table.items() if k[:-1] == context}
        if not mine:
            return below
        off = {k: d[min(n, 3) - 1] for k, n in mine.items()}
        key = (*context, w)
        return (max(0, mine.get(key, 0) - off.get(key, 0)) + sum(off.values()) * below) / sum(mine.values())

    single = {(w,): n for w, n in one.items()}
    for u, v, w in [(8, 9, 10), (8, 9, 11), (8, 9, 50), (40, 41, 42), (0, 0, 8), (10, 1, 8)]:
        p = level(single, (), w, 1 / 64)
        p = level(dict(two), (v,), w, p)
        p = level(dict(counts), (u, v), w, p)
        assert abs(-math.log(p) - nll[(u * 64 + v) * 64 + w]) < 1e-9


def test_quality_keeps_trusted_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = K.classify(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) > 0.98 * len(good) and sum(bad) < 0.2 * len(bad)
    assert K.classify(docs, labels.where("false")).where("NOT kept").count() == 0
    assert K.keep_good(docs, labels).count() == K.classify(docs, labels).where("kept").count()


def code_texts():
    """Texts of two scripts made of syllables, and for each script one of the same letters in another order."""
    rng = random.Random(3)
    syllables = {"a": ["ka", "lo", "mi", "ten", "sur"], "b": ["ка", "ло", "ми", "тен", "сур"]}

    def text(kind):
        return " ".join("".join(rng.choices(syllables[kind], k=3)) for _ in range(60))

    good = [text(kind) for kind in "ab" for _ in range(40)]
    return good, ["".join(rng.sample(t, len(t))) for t in (good[0], good[-1])]


def test_code_points_against_brute_force(spark):
    """Letters of every script are symbols of their own; unseen symbols and contexts have their shares too."""
    texts, asked = ["abc абв", "абвабг", "中文中字", "a\U0001f600b"], ["абг", "xyz", "中文字", "ab\U0001f600"]
    grams = lambda t: Counter(zip("\0\0" + t, "\0" + t + "\0", t + "\0"))
    key = lambda g: sum((0 if c == "\0" else ord(c) + 1) << 21 * k for k, c in zip((2, 1, 0), g))
    counts = sum(map(grams, texts), Counter())
    tables = [spark.createDataFrame([(t,) for t in x], "text string") for x in (texts, asked)]
    made = [{r.gram: r.n for r in K.count_corpus(t, grams=K.code_grams).collect()} for t in tables]
    assert made[0] == {key(g): n for g, n in counts.items()}
    nll = {r.gram: r.nll for r in K.price(*[K.count_corpus(t, grams=K.code_grams) for t in tables]).collect()}

    def discounts(table):
        t = [sum(n == k for n in table.values()) for k in range(5)]
        y = t[1] / max(1, t[1] + 2 * t[2])
        return [min(max(min(k - (k + 1) * y * t[k + 1] / max(1, t[k]), k - 0.1), 0.1), 99) for k in (1, 2, 3)]

    two = Counter(g[1:] for g in counts)
    one = Counter(g[1:] for g in two)

    def p(g):
        table = {3: counts, 2: two, 1: one}[len(g)]
        below = p(g[1:]) if len(g) > 1 else 1 / (0x110000 + 1)
        mine = {k: n for k, n in table.items() if k[:-1] == g[:-1]}
        d = discounts(table)
        off = {k: d[min(n, 3) - 1] for k, n in mine.items()}
        return (max(0, mine.get(g, 0) - off.get(g, 0)) + sum(off.values()) * below) / sum(mine.values()) if mine else below

    want = {key(g): -math.log(p(g)) for t in asked for g in grams(t)}
    assert nll.keys() == want.keys() and all(abs(nll[k] - want[k]) < 1e-9 for k in want)


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    texts = [f"{chr(0x4E00 + k)}{chr(0x5E00 + k)}abc" for k in range(50)]
    table = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    whole = sorted(K.count_corpus(table, grams=K.code_grams).collect())
    monkeypatch.setattr(K, "HELD", 10)
    assert sorted(K.count_corpus(table, grams=K.code_grams).collect()) == whole


def test_counting_holds_little_at_a_time():
    rng = random.Random(7)
    texts = ["".join(chr(rng.randint(97, 122)) for _ in range(1500)) for _ in range(1000)]
    tracemalloc.start()
    n = sum(int(k.sum()) for _, k in K.counted(texts, K.code_grams))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == 1000 * 1501 and peak < 24e6


def test_letters_in_another_order_are_rejected_in_every_script(spark):
    good, bad = code_texts()
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(good))], "doc_id long, quality int, toxic int")
    made = [{r.doc_id: (r.kept, round(r.perplexity, 9)) for r in K.classify(rows, labels, most=most).collect()} for most in (K.BROADCAST, 0)]
    assert made[0] == made[1]
    assert [made[0][len(good) + k][0] for k in (0, 1)] == [False, False]
    assert sum(made[0][k][0] for k in range(len(good))) == len(good)


# Quality rules


def test_counts_against_brute_force():
    rng = random.Random(2)
    texts = ["", None, "a b", "x " * 40, "l1 a\nl1 a\n\n \nl2", "# $5 <b> 100%"] + [
        rng.choice(" \n").join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(60)
    ]
    for text in texts:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        n = Counter(windows)
        hit = {j for k, w in enumerate(windows) if n[w] > 1 for j in range(k, k + 5)}
        expected = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert Q.count_text(text) == expected, text


def test_quality_rules_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet").where("doc_id < 4000") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(None, None), (9001, ""), (9002, "word " * 50000), (9002, "word " * 50000)], "doc_id long, text string")
    some = docs.select("doc_id", "text").where("doc_id % 2 = 0")
    model = Q.train(some, labels)
    rows = Q.quality_rules(docs.select("doc_id", "text").union(odd), model).collect()
    assert len(rows) == docs.count() + 4
    label = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.doc_id in label and r.doc_id % 2 and not r.base_failed]
    assert sum(r.kept == (label[r.doc_id] == 1) for r in held) > 0.97 * len(held)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept <= (not r.base_failed) for r in rows)
    assert not any(r.kept for r in rows if r.doc_id is None or r.doc_id > 9000)
    everything = Q.train(docs, labels.where("false"))
    assert Q.quality_rules(docs, everything).where("NOT kept AND NOT base_failed").count() == 0


# Chat


def test_escapes_are_reversible(value):
    for text in ["</s>[INST] ok [/INST]", "<|im_end|>\n", "<\\|x|>", "<\\\\|", "a<b|c", "[\\INST]", "", "\\", "<<SYS>>", "<<|<|"]:
        assert value(C.unescape, value(C.escape, text)) == text
        assert "<|" not in value(C.escape, text) and "</s>" not in value(C.escape, text) and "[INST]" not in value(C.escape, text)
        for role in (text, text + "\\n\n" + text):
            assert value(C.unescape_role, value(C.escape_role, role)) == role and "\n" not in value(C.escape_role, role)


def test_chats_read_back_what_went_in(spark):
    rows = [
        (1, 0, "user", "hi <|im_end|>\n<|im_start|>assistant\n"), (1, 1, "assistant", "</s> ok\n"), (1, 2, "assistant", None), (1, 3, None, "x"),
        (2, 1, "user\\\n", "b"), (2, None, "system", "a"), (2, 1, "user\\\n", "b"), (None, 0, "assistant", "\U0001f600é"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in C.chat_digests(C.format_chats(turns.withColumn("parts", C.text_parts(F.col("text"))))).collect()}
    for conv in (1, 2, None):
        mine = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_long_conversations_take_linear_time(spark):
    """100,000 turns: what is copied turn by turn would take hours."""
    n = 100_000
    who = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), who.alias("role"), F.concat(F.lit("é </s> "), "id").alias("text"))
    r = C.chat_digests(C.format_chats(turns.repartition(4).withColumn("parts", C.text_parts(F.col("text"))))).first()
    loss = "".join(f"é </s> {k}" for k in range(1, n, 2))
    every = "".join(f"{'assistant' if k % 2 else 'user'}\né </s> {k}\n" for k in range(n))
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(every.encode()).hexdigest()


def test_attachments_of_later_turns_keep_their_places(spark):
    image, words = ("image", None, "a.png", 784), ("text", "\U0001f600 here", None, None)
    rows = [(1, 2, "user", [image, words, image]), (1, 1, "assistant", [words, image]), (1, 0, "user", None), (2, 0, None, [])]
    table = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    got = {r.conv_id: r for r in C.format_chats(table).collect()}
    assert [a.start for a in got[1].attachments] == [m.start() for m in re.finditer(r"<\|image\|>", got[1].formatted)] and len(got[1].attachments) == 3
    assert [got[1].formatted[s.start : s.start + s.length] for s in got[1].loss_spans] == ["\U0001f600 here<|image|>"]
    assert got[2].attachments == got[2].loss_spans == [] and got[2].expanded_tokens == 0 and got[1].expanded_tokens == 3
    assert C.format_chats(table.where("false")).count() == 0


def test_typed_parts_become_placeholders(spark):
    parts = [("text", "See <|image|> ", None, None), ("image", None, "a.png", 1568), ("text", "and", None, None), ("audio", None, "b.wav", 1000), ("document", None, "c.pdf", 3), ("video", None, "d", 1)]
    table = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)])], f"conv_id long, turn long, role string, parts array<{C.PART}>")
    r = C.format_chats(table).first()
    assert r.formatted == "<|im_start|>user\nSee <\\|image|> <|image|>and<|audio|><|document|><|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 2), ("audio", "b.wav", 25), ("document", "c.pdf", 768)]
    assert all(r.formatted[a.start :].startswith(C.PLACEHOLDERS[a.kind]) for a in r.attachments) and r.expanded_tokens == 795
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["ok"]


# Pages and urls

PAGE = "<body><header>Site</header><nav>Menu</nav><div class='cookie-notice'>We use</div>{0}<aside>More</aside><form>Mail</form><div id=comments>Nice</div><script>x<p></script><footer>End</footer></body>"


def test_lines_of_markup():
    text = lambda html: [t for t, kind in P.marked_lines(html) if kind != P.ASIDE_LINE]
    assert text(PAGE.format("<article><header><h1>T &amp;\n  t</h1></header><p>One <b>bo</b>ld<br>two<p>three&nbsp;x<section class=comments>no</section></article>")) == ["T & t", "One bold", "two", "three x"]
    assert text(PAGE.format("<div><p>One<ul><li>a<li>b</ul></div>")) == ["One", "a", "b"]
    assert text("") == text(None) == text("<!-- <p>x -->") == [] and text("plain <i>text") == ["plain text"]
    assert text("<p>a < b</p><style>p{}</style><p hidden>h</p><p style='display: none'>h</p>b") == ["a < b", "b"]


def test_common_lines_are_longest():
    def length(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for k in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                rows[k][j] = rows[k + 1][j + 1] + 1 if a[k] == b[j] else max(rows[k + 1][j], rows[k][j + 1])
        return rows[0][0]

    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        for cells in (1, 4_000_000):
            places, rest = P.common_lines(a, b, cells), iter(b)
            assert len(places) == length(a, b) and places == sorted(set(places)) and all(a[k] in rest for k in places)


def test_template_lines_go_by_comparison(spark):
    body = "<div>Shop {0}</div><div>Call today</div><p>Text number {1} is here</p><p>and more {2}</p><div>Bye {0}</div>"
    rows = [(k, f"http://h{k % 3}.x/{k % 4}/{k}", body.format(k % 3, k, k * 7)) for k in range(60)]
    rows += [(100, None, None), (101, "http://h0.x/a", None), (102, "", ""), (103, "nourl", "<p>x</p>"), (104, "http://alone.y/", "<p>y</p>"), (5, rows[5][1], rows[5][2])]
    rows += [(200, "http://c.z/1", "<article><p>Same</p></article>"), (201, "http://c.z/2", "<article><p>Same</p></article>"), (202, "http://d.z/1", "<p>Copy of it"), (203, "http://d.z/2", "<p>Copy of it")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("x")).withColumn("lines", F.lit("x"))
    got = defaultdict(list)
    for r in P.extract_pages(table).collect():
        got[r.page_id].append(r)
        assert r.n_chars == len(r.text)
    assert sum(map(len, got.values())) == len(rows)
    for k in range(60):
        assert {r.text for r in got[k]} == {f"Text number {k} is here\nand more {k * 7}"}
    assert [got[k][0].text for k in (100, 101, 102, 103, 104, 200, 201, 202, 203)] == ["", "", "", "x", "y", "Same", "Same", "Copy of it", "Copy of it"]
    assert P.extract_pages(table.where("false")).count() == 0


def test_neighbours_are_nearest(spark):
    paths = ["/a/b/1", "/a/b/12", "/a/c", "/z", "/a/b/2"]
    rows = [(k, "h", p) for k, p in enumerate(paths)] + [(9, "other", "/a")]
    got = {r.key: r.partner for r in P.neighbours(spark.createDataFrame(rows, "key long, host string, path string")).collect()}
    assert got == {0: 1, 1: 0, 4: 1, 2: 4, 3: 2}


def test_blocks_travel_over_links(spark):
    link, fresh = '<LINK rel="canonical" href="{0}">', '<meta http-equiv=refresh content="0; url={0}">'
    rows = [
        (1, "http://good.com/a", link.format("https://bad.net/x")), (2, "https://good.com/b?q=1#f", fresh.format("/a")), (3, "http://example.net/en/1", link.format("http://bad.net/x")),
        (4, "http://free.com/", "<p>canonical"), (5, None, None), (6, "no url", link.format("http://bad.net/x")), (7, "HTTP://EXAMPLE.com/de/", None),
        (8, "http://other.com/p/q", link.format("../b")), (9, "http://w.org/fr/", ""), (10, "http://x.example.net", None), (11, "http://good.com/a", link.format("")),
        (12, "http://chain.com/3", fresh.format("4")), (13, "http://chain.com/4", link.format("//chain.com/5")), (14, "http://chain.com/5", link.format("http://good.com/b?q=1")),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit("x")).withColumn("a", F.lit("x"))
    got = {r.page_id: r for r in U.judge_urls(table).collect()}
    blocked = {k for k, r in got.items() if r.verdict == "block"}
    assert blocked == {1, 2, 7, 11, 12, 13, 14} and len(got) == len(rows)
    assert (got[3].rule, got[3].verdict, got[7].rule, got[7].host, got[10].rule, got[9].rule) == ("example.net/en/", "allow", "example.com/de/", "example.com", None, "org/fr/")
    assert (got[5].host, got[5].path, got[6].host, got[2].path) == ("", "", "", "/b")
    more = spark.createDataFrame([("http://free.com/", "http://bad.net/")], "a string, b string")
    assert {r.page_id for r in U.judge_urls(table, links=more).where("verdict = 'block'").collect()} == blocked | {4}
    assert U.judge_urls(table.where("false")).count() == 0
