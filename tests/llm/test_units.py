"""The llm operators' functions against brute force, exact round trips and literal cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumspark.llm import encoding, language, lookalike, mixing, split, subjects, tokenize, truncation


@given(st.text(alphabet="ab .\n!é်က", max_size=200), st.integers(2, 40), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_pieces_give_the_text_again(text, limit, overlap):
    spans = split.spans(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= limit for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert d > b and c == max(0, b - min(overlap, limit - 1))


def test_pieces_end_at_the_coarsest_boundary():
    text = "First sentence here. Second one follows.\n\nNew section starts. It ends."
    pieces = [text[a:b] for a, b in split.spans(text, 45, 0)]
    assert pieces == ["First sentence here. Second one follows.\n\n", "New section starts. It ends."]
    assert [b for _, b in split.spans("x" * 25, 10, 2)] == [8, 16, 24, 25] or all(b - a <= 10 for a, b in split.spans("x" * 25, 10, 2))


def brute_bpe(ranks, word):
    parts = [bytes([b]) for b in word.encode()]
    while len(parts) > 1:
        best = min(((ranks.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == 1 << 40:
            break
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


@pytest.fixture(scope="module")
def ranks():
    return tokenize.load_ranks(f"{tokenize.TOKENIZERS}/byte_bpe_50k.tiktoken")


@given(st.lists(st.text(max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_merge_replay_equals_brute_force(ranks, words):
    assert tokenize.MergeReplay(ranks).encode_words(words) == [brute_bpe(ranks, w) for w in words]


@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet=" a\t\n\x85\xa0'1", max_size=20)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoding_equals_the_public_library(ranks, texts):
    import tiktoken

    public = tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert tokenize.BlockEncoder(ranks).encode(pa.array(texts, pa.string())).to_pylist() == [public.encode_ordinary(t or "") for t in texts]


@pytest.fixture(scope="module")
def repairer():
    good = ["l’équipe qualité conserve l’échantillon d’eau usée – voir § 7", "Größere Beträge über 1.250 € werden geprüft", "“Заря” ½ café naïve", "မူဝါဒ သစ်ပင်", "Ausnahmen benötigen eine Zustimmung", "às alterações", "é – ó"] * 40
    n = np.zeros(encoding.BINS)
    for t in good:
        for w in t.split():
            np.add.at(n, encoding.windows(w), 1)
    return encoding.Repairer(encoding.costs(n))


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251"])
@pytest.mark.parametrize("text", ["l’équipe qualité", "Größere Beträge über", "မူဝါဒ သစ်ပင်"])
def test_misread_utf8_is_restored(repairer, page, text):
    back = {128 + k: c for k, c in enumerate(encoding.code_page(page))}
    bad = "".join(chr(b) if b < 128 else back[b] for b in text.encode())
    assert repairer.text(bad) == (text, True, None)


def test_swapped_double_and_lost(repairer):
    assert repairer.text("Ausnahmen benˆtigen eine") == ("Ausnahmen benötigen eine", True, None)
    twice = "qualité".encode().decode("cp1252").encode().decode("cp1252")
    assert repairer.text(twice) == ("qualité", True, None)
    assert repairer.text("qualit�")[1] and not repairer.text("“Заря” ½ café")[1] and not repairer.text("")[1]


def test_entities_and_escapes(repairer):
    right = "l’équipe qualité"
    coded = lambda f: "".join(c if c.isascii() else f(c) for c in right)
    for f in ("&#{};".format, "&#x{:x};".format, "&amp;#{};".format, "\\u{:04x}".format):
        assert repairer.text(coded(lambda c: f(ord(c)))) == (right, True, None)
    assert repairer.text("qualit&eacute;") == repairer.text("qualit\\xe9") == repairer.text("qualit&amp;eacute;") == ("qualité", True, None)
    assert repairer.text("qualit&Atilde;&copy;") == repairer.text("qualit\\xc3\\xa9") == repairer.text("qualitÃ&copy;") == ("qualité", True, None)
    assert repairer.text("quality &eacute; &ndash; &oacute;")[0] == "quality é – ó"
    assert repairer.text("échantillon qualitÃ© l&rsquo;eau us&eacute;e") == ("échantillon qualité l’eau usée", True, None)
    for same in ("R&amp;D &lt;b&gt; &unknown; &notit; \\x41 \\u0041", r"C:\xact\file", "a & b; c", "qualité R&D"):
        assert repairer.text(same) == (same, False, None)


def test_search_ends_only_when_no_state_is_open(repairer):
    bad = "é"
    for page in ("cp1252", "latin-1", "cp1252", "latin-1"):
        bad = "".join(chr(b) if b < 128 else encoding.code_page(page)[b - 128] for b in bad.encode())
    own = encoding.Repairer(repairer.table)
    assert own.search("", bad, "")[0] == own.search("ab", bad, "c")[0] == "é" and len(own.reachable(bad, lambda t, _: own.cost(t))) > 40
    reached, open_ones = {(bad, False)}, [(bad, False)]
    while open_ones:
        text, swapped = open_ones.pop()
        new = {(op(text), swapped or swaps) for op, swaps in encoding.OPERATIONS if not (swaps and swapped)} - reached
        reached |= new
        open_ones += new
    for slack in (0.0, 1e9):  # the bound on costs leaves out no text
        assert set(own.reachable(bad, own.sum, slack)) == {t for t, _ in reached}
    for before, after in (("", ""), ("a", ""), ("ab", "c"), ("", "cd")):
        costs = {t: own.cost(t) + encoding.STEP for t in own.reachable(before + bad + after, lambda t, _: 0.0)}
        start = own.cost(before + bad + after)
        assert abs(own.search(before, bad, after)[1] - (start - min(costs.values()))) < 1e-3
    for t in ("é", "l’é – ½", "", "abc", "မူé"):
        assert abs(own.cost(t) - repairer.table[encoding.windows(t)].sum()) < 1e-3


def test_forms():
    f = lookalike.form
    assert f("Ｄｏｃ　ｏｎｅ") == "Doc one" and f("eﬃcient") == "efficient" and f("café") == "café"
    assert f("Ροlicy") == "Policy" and f("co‑op\xa0x") == "co-op x" and f("inf​or\xadm") == "inform" and f("P0licy") == "Policy"
    assert f("မူ၀ါဒ ၂၄၀") == "မူဝါဒ ၂၄၀"
    for same in ("“Заря” – ½ 2.º n² € °C … ™", "β-decay", "annex/1b8d644/a0b", "", "plain"):
        assert f(same) == same


@given(st.text(alphabet="abАаеοｅé́​\xa0‑ -0၀ဝ", max_size=30))
@settings(max_examples=200, deadline=None)
def test_form_is_idempotent(text):
    assert lookalike.form(lookalike.form(text)) == lookalike.form(text)


SENTENCES = {
    "en": ["The unit head keeps the signed copy", "Nobody may change the plan without consent", "Earlier versions stay available for reference"],
    "de": ["Die Leitung bewahrt die Fassung auf", "Niemand darf den Plan ohne Zustimmung ändern", "Frühere Fassungen bleiben einsehbar"],
    "fr": ["Le chef garde la copie signée", "Personne ne peut modifier le plan sans accord", "Les versions antérieures restent consultables"],
    "es": ["La jefatura guarda la copia firmada", "Nadie puede modificar el plan sin autorización", "Las versiones anteriores pueden consultarse"],
}


def test_language_model_learns_and_rejects():
    rng = random.Random(1)
    rows = []
    for k in range(400):
        lang = rng.choice(list(SENTENCES))
        words = " ".join(rng.choice(SENTENCES[lang]) for _ in range(2)).split()
        rng.shuffle(words)
        rows.append((lang if k % 20 else "fr", [" ".join(words) + f" {k}."]))
    m = language.fit(rows)
    got, conf = m.predict([language.words(SENTENCES[x][2]) for x in SENTENCES] + [[]])
    assert [language.LANGUAGES[g] for g in got[:4]] == list(SENTENCES) and got[4] == -1
    assert language.fit([]).predict([["word"]])[0][0] == -1


def test_language_labels_and_whole_sentences():
    assert [language.label_code(x) for x in ("en-GB", "DE", " fra ", "Burmese", "und", "", None, "xx")] == ["en", "de", "fr", "my", None, None, None, None]
    assert language.is_whole("The unit head signs it.", ["the", "unit", "head", "signs", "it"]) and not language.is_whole("the noise barrier log;", ["the", "noise", "barrier", "log"])


def test_truncation_classifier_on_held_out_cuts():
    rng = random.Random(2)
    units = ["The unit head", "The quality team", "The policy owner"]
    ends = ["keeps the signed copy.", "reviews the plan every month.", "answers questions by noon on Friday."]
    texts = [f"{rng.choice(units)} {rng.choice(ends)} {rng.choice(units)} {rng.choice(ends)}" for _ in range(1500)] + ["Type: Policy", "the signed copy"] * 100
    words, spikes = truncation.word_counts(pa.array(texts)), np.zeros(truncation.LENGTHS, bool)
    with_source = [(t, truncation.Source([t]) if k % 2 else truncation.NO_SOURCE, k % 5 == 0) for k, t in enumerate(texts)]
    m = truncation.fit(with_source, words, spikes)
    cuts = truncation.cut_values([x[:2] for x in with_source[:300]], spikes, np.random.default_rng(9))
    whole = [truncation.value(*x[:2]) for x in with_source]
    assert (m.score(cuts) >= 0.5).mean() > 0.9 and (m.score(whole) < 0.5).mean() > 0.99
    assert truncation.fit([], words, spikes).score([("x", "x", "-")])[0] < 1e-6 and len(m.score([])) == 0


def test_score_is_calibrated_to_the_share_of_cut_values():
    m = truncation.Model(np.zeros(2 * truncation.WORDS), np.zeros(truncation.LENGTHS, bool))
    rng = np.random.default_rng(4)
    cut = rng.random(20_000) < 0.04
    m.logits = lambda rows: rows  # the log odds of a fit on as many cut as whole values
    odds = rng.normal(np.where(cut, 3.0, -3.0), np.sqrt(6.0))
    m.calibrate(odds, 0.5)
    p = 1 / (1 + np.exp(-(odds + m.shift)))
    assert abs(p.mean() - cut.mean()) < 0.005 and 0.4 < cut[(p > 0.4) & (p < 0.6)].mean() < 0.6


def test_place_in_the_source():
    source = truncation.Source(["The unit head keeps it. The team signs the plan.", None, "", "the signed copy", "one\ttwo  three goes on"])
    place = {t: source.place(t) for t in ("The unit head keeps it.", "The unit head keeps it. The te...", "The team si", "The team.", "the signed copy", "Unknown text that", "• the signed copy", "first\nThe team signs the", "one two three")}
    assert list(place.values()) == ["s0", "i0", "i0", "i0", "p0", "-", "p0", "i1", "i2"] and truncation.NO_SOURCE.place("x") == "-"


def test_limits_are_lengths_with_many_values():
    n = np.full(truncation.LENGTHS, 1)
    n[255] = 40
    assert np.flatnonzero(truncation.limits(n)).tolist() == [255]


def test_limits_of_any_length_and_in_small_tables(spark):
    texts = ["ab " * (10 + 7 * k) + "x" for k in range(60)] + ["y" * 32_767] * 9 + ["z" * 10_000] * 6
    n, _, spikes = truncation.statistics(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert n == len(texts) and np.flatnonzero(spikes).tolist() == [10_000, 32_767]
    words = np.zeros(2 * truncation.WORDS, np.int32)
    assert truncation.features(*["y" * 32_767] * 2, "-", words, spikes) != truncation.features(*["y" * 32_767] * 2, "-", words, np.zeros_like(spikes))
    assert truncation.limits(np.zeros(0, int)).sum() == 0


def test_subject_models_on_held_out_documents():
    rng = random.Random(3)
    topics = [["the tax return", "the petty cash box", "the bank loan"], ["the relay team", "the match calendar", "the goalkeeper rota"], ["the lesson plan", "the pupil register", "the final exam"]]
    frames = ["The unit head reviews {} every month.", "Nobody may change {} without consent.", "Questions about {} go to the desk."]

    def doc(subjects):
        return "\n".join(" ".join(rng.choice(frames).format(rng.choice(topics[s])) for _ in range(2)) + " Earlier versions stay available." for s in subjects for _ in range(2))

    made = [[k % 3] if k % 4 else [k % 3, (k + 1) % 3] for k in range(160)]
    labelled = [(doc(s), "en", set(s)) for s in made]
    slots = subjects.lang_slot(["en", None, "EN-us", "xx"] * (len(labelled) // 4 + 1), ["en"])[: len(labelled)]
    m = subjects.fit(subjects.background(subjects.Tokens(pa.array([x[0] for x in labelled]), slots), slots), [(x[0], x[2]) for x in labelled], 3)
    test = [doc([k % 3]) for k in range(30)] + ["", None]
    t = subjects.Tokens(pa.array(test, pa.string()), m.languages)
    got = {(d, s) for d, s, _ in m.decide(t, m.scores(t), m.threshold)}
    assert subjects.f_score(got, {(k, k % 3) for k in range(30)}) > 0.9


def test_rates_stay_within_caps():
    r = mixing.rates(np.array([0, 1]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([3.0, 0.1]), np.array([2.0, 1.0]), [(np.array([-1.0, 1.0]), np.zeros(2))])
    assert r.tolist() == [2.0, 0.0]


def mixing_passes(soft, tokens, label, caps, wanted, weight):
    """The descent over documents in one place: the rates, and the squared residual of the expected totals."""
    there = np.bincount(label, tokens, len(caps))
    start, descent = wanted / there, mixing.Descent(wanted, weight)
    for _ in range(30):
        r = mixing.rates(label, soft, start, caps, descent.history)
        free = np.where((r > 0) & (r < caps[label]), tokens, 0)
        cross = np.stack([np.bincount(label, free * soft[:, c], len(caps)) for c in range(len(caps))], 1)
        descent.step((r * tokens) @ soft, np.bincount(label, r * tokens, len(caps)), np.bincount(label, free, len(caps)), cross, (soft * free[:, None]).T @ soft)
    descent.history.pop()
    r = mixing.rates(label, soft, start, caps, descent.history)
    return r, float((((r * tokens) @ soft - wanted) ** 2).sum())


def test_memberships_drive_the_rates():
    rng = np.random.default_rng(1)
    n, k = 600, 4
    label = rng.integers(0, k, n)
    soft = rng.dirichlet(np.full(k, 0.5), n) * 0.6
    soft[np.arange(n), label] += 0.4
    tokens, caps = rng.integers(20, 300, n).astype(float), np.array([1.0, 2.0, 3.0, 1.0])
    wanted = np.array([0.5, 0.2, 0.2, 0.1]) * 0.4 * np.bincount(label, tokens, k).min() / 0.5
    r, left = mixing_passes(soft, tokens, label, caps, wanted, 1.0)
    even, off = mixing_passes(soft, tokens, label, caps, wanted, 0.0)
    assert left < 0.05 * off and np.abs(r - even).max() > 0.05
    assert np.allclose(np.bincount(label, r * tokens, k), wanted, rtol=0.01) and (r >= 0).all() and (r <= caps[label]).all()


def test_memberships_are_calibrated_and_of_every_document():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(("tax", "levy", "return", "the", "of") if k % 2 else ("relay", "match", "team", "the", "of"), k=12)) for k in range(200)]
    d = mixing.Domains(texts, np.arange(200) % 2, 2)
    p = d.posteriors(pa.array(["tax levy the", "relay team of", "", None], pa.string()))
    assert p[0, 1] > 0.9 and p[1, 0] > 0.9 and np.allclose(p.sum(1), 1) and np.allclose(p[2], p[3])


def test_hot_documents_are_split_and_give_the_same_scores(spark, monkeypatch):
    vals = spark.createDataFrame([("section_slots", d, 1, k, f"The unit head keeps copy {k}") for d in ("hot", "cold", None) for k in range(60)], "tab string, doc_id string, slot_id int, para_idx int, text string")
    cleaned = spark.createDataFrame([(d, [f"The unit head keeps copy {k} of it." for k in range(60)]) for d in ("hot", "hot", "hot", "cold", None)] + [("hot", None)], "doc_id string, paragraphs array<string>")

    class Places:
        value = type("M", (), {"score": lambda self, vs: np.array([v[2] == "i0" for v in vs], float)})()

    want = {("hot", k, 1.0) for k in range(60)} | {("cold", k, 1.0) for k in range(60)} | {(None, k, 0.0) for k in range(60)}
    for hot, deliveries in ((20_000, 1000), (10, 1000), (10, 2)):
        monkeypatch.setattr(truncation, "HOT_VALUES", hot)
        monkeypatch.setattr(truncation, "HOT_DELIVERIES", deliveries)
        rows = truncation.by_document(spark, vals, cleaned)
        assert rows.filter("kind = 1").count() == 180 and rows.select("doc_id", "salt").filter("doc_id = 'hot'").distinct().count() == (1 if hot > 60 else 6)
        assert {(r.doc_id, r.para_idx, r.score) for r in truncation.score_values(rows, Places).collect()} == want


def test_every_language_has_its_own_slot_and_labels_do_not_decide():
    codes = ["en", "my", "fr", "de", "es", "pt", "nl"]
    assert subjects.lang_slot([*codes, None, "", "xx", "PT-br"], codes).tolist() == [1, 2, 3, 4, 5, 6, 7, 0, 0, 0, 6]
    texts = ["the unit keeps the plan and the register"] * 9 + ["die stelle führt das register und den plan"] * 9
    slots = subjects.lang_slot(["en"] * 8 + ["de"] + ["de"] * 8 + [None], ["en", "de"])  # one wrong label, one missing
    counts = subjects.background(subjects.Tokens(pa.array(texts), slots), slots).reshape(subjects.LANGS + 2, -1)
    found = subjects.Tokens(pa.array([*texts, None, ""], pa.string()), subjects.Languages(counts[: subjects.LANGS])).slots
    assert found[:18].tolist() == [1] * 9 + [2] * 9


def test_own_thresholds_lean_on_the_common_one():
    true = {(d, 0) for d in range(100)} | {(200, 1)}
    decided = {0.0: true | {(d, 0) for d in range(100, 180)}, 2.0: set(true), 4.0: {(d, 0) for d in range(20)} | {(200, 1)}}
    assert subjects.own_thresholds(decided, true, 3, 0.0).tolist() == [2.0, 0.0, 0.0]


def test_probes_of_other_scripts_and_compatibility_forms():
    f = lookalike.form
    assert f("ɡo") == "go" and f("\u212b\u212a\u2126") == "\u00c5K\u03a9" and f("\uf900") == "\u8c48" and f("\u1100\u1161") == "\uac00"
    assert f("hоusе") == "house" and f("օffice") == "office" and f("Ꮢeport") == "Report" and f("пoлитика") == "политика"
    assert lookalike.spell("ор")[1] == "whole_script" and lookalike.spell("дом")[1] is None and f("ор") == "ор"
    assert lookalike.scripts("ー") == {"Hiragana", "Katakana"} and lookalike.spell("カー")[1] is None


def test_texts_of_inert_characters_are_their_own_form():
    import regex

    pattern = regex.compile(regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", lookalike.candidate()))
    inert = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not pattern.match(chr(c))]
    assert set("abz09é’“”–…ßñကမ") <= set(inert) and not set("\u212b\u212a\uf900\u1161о\u00ad၀") & set(inert)
    assert all(lookalike.form(c) == c for c in inert)
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choices(inert, k=6))
        assert pattern.search(t) or lookalike.form(t) == t
