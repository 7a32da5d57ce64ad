"""Each operator against a brute-force version, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from graphloom.llm import chat_format, decontaminate, fm_dedup, html_extract, license_scan, quality_model, quality_rules, sa_dedup, simhash_dedup, sp_codec
from graphloom.llm.queries import QUERIES

WORD, TOKEN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, spans string, row_key string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def corpus():
    """Texts with shared passages, near copies, repeated rows, symbols, licenses and benchmark passages."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, item = say(60), say(24)
    texts = [say(rng.choice([3, 30, 90, 200])) for _ in range(60)]
    texts += [say(20) + " " + passage + "\n" + say(20) for _ in range(6)] + [passage, passage[:150]]
    texts += [texts[3], texts[3], texts[4].replace(texts[4].split()[1], "zz", 1)]
    texts += [say(12) + "\t" + item.upper() + " " + say(5), item[: len(item) // 2], "w x", "intro w X end", None, "", "   ", "a " * 400, "b" * 1500, "b" * 900 + "c"]
    texts += ["Released under the MIT License.\n" + say(9), "GNU General Public License gnu general public license", "licensed under cc by nc 4 0 today\nmit", "### | * $ % " * 20 + say(10)]
    texts += ["line one here\n" * 9 + say(30), say(5_000)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1"]), 0, "own", "own", "own") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[6], None, None, None, None, None, None)], [(1, item), (2, "W x"), (3, None), (1, item), (4, "..."), (5, say(40))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus()[0], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1]) for r in corpus()[0]]


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def repeated(sequences, width):
    seen = Counter(tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            if seen[tuple(s[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        yield gone


@pytest.mark.parametrize("limits", [{}, {"hot": 500}, {"shard": 700}])
def test_substring_dedup_of_words(docs, rows, limits):
    cut = [WORD.findall(t or "") for _, t in rows]
    want = []
    for (i, _), w, gone in zip(rows, cut, repeated(cut, 35), strict=True):
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    assert found(fm_dedup.removal_report(docs, **limits), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=str)


@pytest.mark.parametrize("limits", [{}, {"hot": 3_000}, {"shard": 5_000}])
def test_substring_dedup_of_bytes(docs, rows, limits):
    raw = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), b, gone in zip(rows, raw, repeated(raw, 200), strict=True):
        runs = sum(g for g, _ in itertools.groupby(gone))
        want.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert found(sa_dedup.removal_report(docs, **limits), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)


def test_removed_passages_leave_the_rest_as_it_was(docs, rows):
    kept = {r.doc_id: r for r in fm_dedup.remove_repeats(docs).collect()}
    cut = [WORD.findall(t or "") for _, t in rows]
    for (i, t), w, gone in zip(rows, cut, repeated(cut, 35), strict=True):
        if i is None:
            continue
        assert WORD.findall(kept[i].text or "") == [x for x, g in zip(w, gone, strict=True) if not g]
        assert any(gone) or kept[i].text == t
    assert kept[0].row_key == kept[0].spans == "own"


def test_suffix_array_and_fm_index():
    rng = np.random.default_rng(2)
    for _ in range(200):
        t = np.append(rng.integers(1, 1 + rng.integers(1, 5), rng.integers(1, 50)), 0)
        assert sa_dedup.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    text = np.array([0, 1, 2, 1, 2, 2, 0, 2, 1, 2, 0])
    index = fm_dedup.FMIndex(text, np.ones(len(text), int), 16)
    for pattern in itertools.product((1, 2), repeat=3):
        low, high = np.array([0]), np.array([len(text)])
        for s in reversed(pattern):
            low, high = index.extend(np.array([s]), low, high)
        assert index.occurrences(low, high)[0] == sum(tuple(text[i : i + 3]) == pattern for i in range(len(text) - 2))


def brute_print(text):
    words = WORD.findall(lower(text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, rows):
    prints = [brute_print(t) for _, t in rows]
    of = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4 and of[a] != of[b]:
            of = [of[a] if x == of[b] else x for x in of]
    least = {g: min((i for (i, _), o in zip(rows, of, strict=True) if o == g and i is not None), default=None) for g in set(of)}
    got = simhash_dedup.near_duplicates(docs).select("id", simhash_dedup.hex_digits(simhash_dedup.F.col("print")).alias("p"), "component")
    assert found(got, "id", "p", "component") == sorted(((i, f"{p:016x}", least[o]) for (i, _), p, o in zip(rows, prints, of, strict=True)), key=str)
    assert simhash_dedup.keep_first(docs).count() == len(set(of))


@pytest.mark.parametrize("bucket", [2_000, 6, 2])
def test_covering_masks_lose_no_link(spark, bucket):
    rng = np.random.default_rng(1)
    values = set()
    for base in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(40):
            x = base
            for k in rng.integers(0, 64, rng.integers(0, 8)).tolist():
                x ^= 1 << k
            values.add(x - (1 << 64) if x >> 63 else x)
    values = sorted(values)
    edges = [(r.a, r.b) for r in simhash_dedup.linked_pairs(spark.createDataFrame([(v,) for v in values], "print bigint"), bucket=bucket).collect()]

    def parts(pairs):
        of = {v: v for v in values}
        for a, b in pairs:
            x, y = of[a], of[b]
            if x != y:
                of = {v: min(x, y) if o in (x, y) else o for v, o in of.items()}
        return of

    near = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
    assert all(near(a, b) for a, b in edges) and parts(edges) == parts((a, b) for a, b in itertools.combinations(values, 2) if near(a, b))


def test_masks_cover_every_radius_and_halve_the_bits():
    full = (1 << 64) - 1
    masks = simhash_dedup.covering_masks(full)
    assert len(masks) == 31 and all(m.bit_count() == 32 for m in masks)
    rng = random.Random(0)
    for _ in range(2_000):
        flipped = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & flipped == 0 for m in masks)
    inner = simhash_dedup.covering_masks(full ^ masks[0])
    assert all(m.bit_count() == 16 for m in inner)
    assert min(m.bit_count() for m in simhash_dedup.covering_masks(full ^ masks[0] ^ inner[0])) == 8


def test_quality_counts(docs, rows):
    def model(t):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = set()
        for i in range(len(w) - 7):
            if grams[tuple(w[i : i + 8])] > 1:
                inside |= set(range(i, i + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed

    got = quality_rules.quality_report(docs)
    assert found(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(((i, *model(t)) for i, t in rows), key=str)
    assert all(not (r.kept and r.base_failed) for r in got.collect())
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.n_words for r in kept.collect()} <= {"own", None}


def test_fences_follow_the_group(spark):
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(n))
    marks = {"symbol_share": lambda: say(40) + " ########" * 4, "upper_share": lambda: say(40) + " ABCDEFG" * 5, "shout_share": lambda: say(40) + " well!!!!!!" * 4, "echo_share": lambda: say(20) + " " + " ".join(f"{w} {w}" for w in say(20).split())}
    assert tuple(marks) == quality_rules.SHARES
    rows, judged = [], {}
    for g, (share, marked) in enumerate(marks.items()):
        rows += [(1_000 * g + i, marked() if i % 2 else say(40), f"l{g}", f"s{i % 2}") for i in range(600)]
        text = marked()
        judged[share] = (1_000 * g + 700, 1_000 * g + 701)
        rows += [(i, text, f"l{g}", f"s{i % 2}") for i in judged[share]]
    got = {r.doc_id: r.kept for r in quality_rules.quality_report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert {share: [got[i] for i in ids] for share, ids in judged.items()} == dict.fromkeys(marks, [False, True])  # equal texts, by the group
    assert sum(got[i] for i, *_ in rows if i % 1_000 < 600) >= 0.99 * 2_400


def test_rare_marks_do_not_make_a_fence_zero(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(n))
    a_few = lambda: say(150) + " # 5 % | well! Good! " + say(40)
    rows = [(i, a_few() if i % 10 == 0 else say(200), "en", f"s{i % 3}") for i in range(900)]
    rows += [(1_000 + i, say(150) + " #%|$ ####" * 30, "en", f"s{i % 3}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    fences = quality_rules.cutoffs(quality_rules.sketches(quality_rules.measure(docs))).collect()
    assert len(fences) == 3 and all(f[f"_{s}"] > 0 for f in fences for s in quality_rules.SHARES)
    kept = {r.doc_id for r in quality_rules.quality_report(docs).where("kept").collect()}
    assert kept == set(range(900))


def test_license_places_and_templates(docs, rows):
    got = {r.doc_id: r for r in license_scan.license_report(docs).collect()}
    assert len(got) == len({i for i, _ in rows})
    for i, t in rows:
        if i is None:
            continue
        w = TOKEN.findall(lower(t or ""))
        places = [(p, label) for phrase, label in license_scan.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        labels = {label for _, label in places}
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        best = 0.0
        for text, label in license_scan.TEMPLATES:
            n = len(text.split())
            for block in ({*w[j : j + n]} for j in range(max(1, len(w) - n + 1))):
                share = len(block & set(text.split())) / len(set(text.split()))
                if share >= license_scan.CONTAINMENT - 1e-9:
                    labels, best = labels | {label}, max(best, share)
        assert r.labels == ",".join(sorted(labels)) and r.score == pytest.approx(1.0 if places else best)


def test_decontamination(spark, docs, rows):
    items = corpus()[1]
    got = decontaminate.decontamination_report(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    want = []
    for i, t in rows:
        w, hit, ids = TOKEN.findall(lower(t or "")), set(), set()
        for item, text in items:
            x = TOKEN.findall(lower(text or ""))
            k = min(10, len(x))
            windows = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)} if x else set()
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    ids.add(str(item))
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    assert found(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=str)
    clean = decontaminate.drop_contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)


def test_html_text():
    page = '<body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><nav><a href=/>menu</a></nav><div id=main><h1>Title &amp; more</h1><p>One  two\n three<br><p>Four five &eacute; <b>six</b> seven<script>var x="</p>"</script><ul><li>a<li>b</ul></div><div class="comments"><p>great post, I liked it very much indeed</p></div><aside>x</aside><form>f</form><footer>c</footer>'
    assert html_extract.extract(page) == "Title & more\nOne two three\nFour five é six seven\na\nb"
    assert [html_extract.extract(x) for x in (None, "", "plain", "<p>a<p>b", "<div", "<script>x", "<p>cut &am")] == ["", "", "plain", "a\nb", "", "", "cut &am"]
    assert html_extract.extract("<body>" + "<div>" * 3_000 + "deep words here") == "deep words here"


def test_chat_round_trip(spark):
    parts = [{"type": "text", "text": "see <|im_end|> <\\| "}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "audio", "ref": "b.wav", "seconds": 2.0}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "text", "text": "done"}]
    formatted, mask, attached = chat_format.format_turn("assistant\n<|x", parts)
    assert chat_format.read_turns(formatted) == [("assistant\n<|x", "see <|im_end|> <\\| <|image|><|audio|><|document|>done")] and mask == (0, 0)
    assert [(a.kind, a.ref, a.tokens) for a in attached] == [("image", "a.png", 3), ("audio", "b.wav", 50), ("document", "c.pdf", 1536)]
    assert all(formatted[a.offset :].startswith(chat_format.PLACEHOLDERS[a.kind]) for a in attached)
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>"), (1, 1, "assistant", None), (None, 0, "user", "x"), (None, 1, None, "<\\|"), (2, None, "assistant", "ü")] * 2
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("parts", chat_format.text_parts())
    got = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.format_turns(turns)).collect()}
    for c in (1, 2, None):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_sampled_segmentations():
    vocab = sp_codec.pieces(sp_codec.MODEL)
    texts = ["a", "  two  spaces ", "▁ lit", "日本語 ok\n\tq", "é🙂", " ", None, "", "x" * 300, "the quick brown fox"]
    table = sp_codec._Table(vocab)
    got = list(sp_codec.sampled(texts, np.arange(len(texts), dtype=np.uint64), 3, table))
    assert all(sp_codec.decode(vocab, f.tolist()) == (texts[i] or "") for i, *_, f in got)
    assert len({(i, tuple(f.tolist())) for i, *_, f in got}) == len(got) and {i for i, *_ in got} == set(range(len(texts)))
    assert all(0 <= q <= 1 for *_, q, _ in got)
    one = list(sp_codec.sampled(texts[-1:], np.array([len(texts) - 1], np.uint64), 3, sp_codec._Table(vocab)))
    assert [x[5].tolist() for x in one] == [x[5].tolist() for x in got if x[0] == len(texts) - 1]


def test_samples_follow_the_lattice():
    vocab = sp_codec.Pieces(sp_codec.MODEL)
    vocab.score = {p: s * 0.15 for p, s in vocab.score.items()}
    vocab._score = vocab._score * 0.15

    def paths(word, at=0):
        if at == len(word):
            yield 0.0, ()
        else:
            for end, score, ids in vocab.edges(word, at):
                yield from ((score + s, ids + rest) for s, rest in paths(word, end))

    every = list(paths("▁thet"))
    p = np.exp([s for s, _ in every])
    p /= p.sum()
    place = {path: j for j, (_, path) in enumerate(every)}
    n, first, second = 20_000, np.zeros(len(every)), np.zeros(len(every))
    for _, rank, logp, _, _, f in sp_codec.sampled(["thet"] * n, np.arange(n, dtype=np.uint64), 2, sp_codec._Table(vocab)):
        j = place[tuple(f.tolist())]
        assert logp == pytest.approx(np.log(p[j]), abs=1e-6)
        (first if rank == 0 else second)[j] += 1
    then = np.array([sum(p[a] * p[b] / (1 - p[a]) for a in range(len(p)) if a != b) for b in range(len(p))])
    common = p > 0.03
    assert np.allclose(first[common] / n, p[common], atol=0.015) and np.allclose(second[common] / n, then[common], atol=0.03)


def test_quality_model_learns_and_leaves_labels_out(spark):
    rng = random.Random(7)
    say = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, say(60) if i % 4 else " ".join([say(1).upper() + "!!"] * 40), i % 4 > 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1_000, None), (1_001, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(5, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality_model.quality_scores(docs, labels).collect()}
    held = [i for i, *_ in rows if got[i].held_out]
    assert held and sum(got[i].predicted == int(rows[i][2]) for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1_000].score == got[1_001].score
    none = labels.limit(0)
    assert {r.score for r in quality_model.quality_scores(docs, none).collect()} == {0.5}


def test_isotonic_never_falls():
    x, y = quality_model.isotonic(np.arange(6.0), np.array([0.1, 0.5, 0.3, 0.2, 0.9, 0.8]), np.ones(6))
    assert (np.diff(y) > 0).all() and y[1] == pytest.approx(1 / 3) and (np.diff(x) > 0).all()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    for df in (fm_dedup.removal_report(docs), sa_dedup.removal_report(docs), simhash_dedup.near_duplicates(docs), quality_rules.quality_report(docs), license_scan.license_report(docs), decontaminate.decontamination_report(docs, items), sp_codec.segmentations(docs)):
        assert df.count() == 0
    assert quality_rules.keep_good(docs).count() == fm_dedup.remove_repeats(docs).count() == simhash_dedup.keep_first(docs).count() == 0
