import random
import string

import numpy as np
import pytest

from pyspark.sql import functions as F

from ledgerloom.llm import neardup, residue as residue_module
from ledgerloom.llm.neardup import LabelSpread, alike, hamming, hot_keys, probe_values, simhash, simhash_values, spread_labels, table_keys, tables_of
from ledgerloom.llm import residue_data as R
from ledgerloom.llm.residue import is_mashed, residue, slot_mark, slot_pattern
from ledgerloom.llm.wordless import fit, score

FOUND = {
    "template": [
        "The motion was carried with {{votes}} votes in favour.", "Question put by [SPEAKER_NAME] on behalf of the group.", "As <MINISTER> told us, the matter is urgent.", "I agree with [insert name of the member here] on every point.", "Sitting of XX.XX.20XX, morning part.",
        "Sitting of dd/mm/yyyy, morning part.", "%MEMBER% (Lantern Union): Thank you.", "Séance du <<date_seance>>, matin.", "Das Wort erhält (Name folgt) für die Fraktion.", "Sesión del &lt;fecha_sesion&gt;, mañana.", "The clause enters into force on $(sitting_day).",
        "As ｛｛constituency｝｝ told us, the matter is urgent.", "Question put by {{ member.full_name | upper }} on behalf of the group.", "I agree with [TBC - member's name] on every point.", "The motion was carried with NN votes in favour.",
    ],
    "script": ["Please enable JavaScript to view this transcript.", "THIS PAGE NEEDS SCRIPTS TO RUN.", "A real speech.\nScripts are blocked. Allow them and reload the page.", "Votre navigateur n'exécute pas les scripts.", "JavaS​cript is d​isabled in your browser.", "You must enable JavaScript to use this site."],
    "error": ["404 Not Found", "HTTP 502 Bad Gateway", "The transcript you requested could not be found on this server.", "Error 503", "Sitzung abgelaufen", "We told them so.\nInternal Server Error\nThank you.", "Reference: 8842-17", "Unable to con-\nnect to the transcript database."],
    "filler": ["Lorem ipsum goes here until the final wording arrives.", "bla bla bla bla bla", "xxx XXXXX xxxx xxx", "Thank you. klwk klwk kwlk klwk kwlk kwlk", "Texte factice texte factice.", "test test test 123"],
}
CLEAN = [
    "I read from the notice sent to Lunton: \"Please enable JavaScript to view this transcript\", and that was all they got.", "What they saw for weeks was this: 'Scripts are blocked. Allow them and reload the page'.", "The letter to Silez began 'Dear {{first_name}}', which shows how much care went into it.",
    "The member's speech was lorem ipsum from start to finish, if I may put it so.", "For six weeks the ministry's own page answered farmers with error 404, and nobody noticed.", "Not found, not found, not found: that is all the archive replied.", "Access denied, said the gatekeeper in Halva, and so we turned back.",
    "(Laughter) [Applause from the benches] <inaudible> {crosstalk} Thank you.", "See note [3] and [ANNEX B] of the report, and item {a} of the list.", "Between 10% and 15% of the households are affected, and <b>none</b> was asked.", "The bridge toll is $5 for cars and $7 for everyone else.", "The sitting is resumed.", "All I heard was bla bla bla.",
    "The form demands a browser with scripts switched on, and the clerk has none.", "[Navmar Ubrinoholm: That is untrue!]", "I asked for the placeholder in clause 3 to be replaced by a real number, and it was.", "", None, "   \n\n ", "The committee has costed the plan for the harbour of the town. " * 5_000, "Hear, hear!",
]


def test_what_is_residue_and_what_is_not(frame):
    rows, want = [], {}
    for kind, texts in FOUND.items():
        for t in texts:
            rows.append((len(rows), t))
            want[len(rows) - 1] = kind
    rows += [(len(rows) + i, t) for i, t in enumerate(CLEAN)]
    rows.append((900, "and so we said that it was right " * 9_000 + "\nPlease enable JavaScript to view this transcript.\n" + "but then they said no to all of it " * 9_000))
    want[900] = "script"
    rows.append(rows[0])
    got = {r.doc_id: r.kinds for r in residue(frame("doc_id bigint, text string", rows)).collect()}
    texts = dict(rows)
    assert {texts[d][:60] for d in want if d not in got} == set()
    assert {(texts[d] or "")[:60] for d in got if d not in want} == set()
    assert all(want[d] in k for d, k in got.items())


def test_near_duplicates_take_over_the_label(frame):
    one = "An unexpected condition was encountered while loading the speech."
    two = one.replace("loading", "loadimg")
    rows = [(1, one), (2, two), (3, "The committee has costed the plan for the harbour of the town.")]
    assert {r.doc_id for r in residue(frame("doc_id bigint, text string", rows)).collect()} == {1, 2}


def test_repeated_words_start_the_search_as_a_whole_only(frame):
    r = random.Random(3)
    plain = lambda: " ".join(r.choice("the committee has costed plan for winter road clearing and says so with regret because of warnings from town".split()) for _ in range(9))
    normal = "Ce gouvernement rejette l'amendement relatif au dragage du port de la ville de Lunton et de ses environs"
    texts = ["kwlkab kwlkab kwlkab kwlkab kwlkab kwlkab", "kwlkab kwlkab", "essai essai " + normal, normal, normal + " klwk klwk klwk klwk klwk", normal + " bla bla bla bla"]
    rows = list(enumerate(texts)) + [(100 + i, plain()) for i in range(1_600)]
    assert {x.doc_id for x in residue(frame("doc_id bigint, text string", rows)).collect()} == {0, 1, 2, 4}


def grams(text):
    t = f" {text} "
    return {t[i : i + 3] for i in range(max(1, len(t) - 2))}


def like(x, y, least):
    a, b = grams(x), grams(y)
    return len(a & b) >= least * len(a | b) and min(len(x), len(y)) + 2 >= least * (max(len(x), len(y)) + 2)


def texts_frame(frame, rows):
    """(pid, norm, label, seed) as LabelSpread takes them."""
    return frame("pid bigint, norm string, label string, seed boolean", rows).withColumns({"pid": F.struct(F.col("pid").alias("a")), "sim": simhash(F.col("norm"))})


def spread_pids(df, *args):
    return sorted((x.pid.a, x.label) for x in spread_labels(df, *args).collect())


def test_labelled_rows_start_and_carry_the_search(frame):
    """A chain a - b - c - d with links between neighbours only."""
    r = random.Random(4)
    a = "".join(r.choice(string.ascii_lowercase + "   ") for _ in range(80))
    chain = [a]
    for i in range(3):
        x = list(chain[-1])
        for j in (20 * i + 10, 20 * i + 18):
            x[j] = "#"
        chain.append("".join(x))
    assert all(like(x, y, 0.8) for x, y in zip(chain, chain[1:])) and not any(like(x, y, 0.8) for x, y in zip(chain, chain[2:]))
    # The first is a known wording, the second has a label of its own that starts no search, but stands between the first and the rest.
    rows = [(i, t, ["error", "filler", None, None][i], i == 0) for i, t in enumerate(chain)]
    df = texts_frame(frame, rows)
    assert spread_pids(df, 40, 0.8) == [(0, "error"), (1, "filler"), (2, "filler"), (3, "filler")]
    # Without the column every labelled row is a seed.
    assert spread_pids(df.filter("pid.a > 0").drop("seed"), 40, 0.8) == [(1, "filler"), (2, "filler"), (3, "filler")]


def test_filler_held_by_many_documents(frame):
    r = random.Random(6)
    latin = lambda: " ".join("".join(r.choice(["qui", "gra", "ul", "bea", "nu", "est", "or", "um", "ve", "lis"]) for _ in range(4)) for _ in range(8))
    plain = lambda: " ".join(r.choice("the committee has costed plan for winter road clearing and says so with regret because of warnings from town".split()) for _ in range(8))
    hot, formula = latin(), "I herewith declare today's proceedings suspended"
    rows = [(i, f"Lorem ipsum dolor. {latin()}. {latin()}.") for i in range(40)]
    rows += [(1_000 + i, f"{plain()}. {plain()}.") for i in range(300)]
    rows += [(2_000 + i, f"{hot}. {plain()}.") for i in range(1_000)]
    rows += [(4_000 + i, f"{formula}. {plain()}.") for i in range(1_000)]
    got = {x.doc_id for x in residue(frame("doc_id bigint, text string", rows)).collect()}
    assert got == {*range(40), *range(2_000, 3_000)}


def test_every_slot_passes_the_pre_filter(frame):
    words = [o + before + w + after + c for w in R.ASKING for o, c in ["()", "[]", "<>", "{}", "(]"] for before, after in [("", ""), ("Name: ", " - the speaker"), ("a rather long note before this, ", "")]]
    fields = [f"{o}{w}{c}" for w in R.FIELDS for o, c in ["[]", "<>", "{}"]]
    others = ["{{votes}}", "${day}", "#{day}", "{% day %}", "<%= day %>", "@@day@@", "%(day)s", "$(day)", "[[day]]", "<<day>>", "__day__", "%member%", "$member$", "|member|", "<first_name>", "____", "xx.xx.20xx", "jour mois année", "día mes año", "tag monat jahr", "day month year", "nn votes", "xx votos"]
    others += ["first name surname", "vorname nachname", "prénom nom", "prenom nom", "nombre apellidos"]
    others += [f"{d}{s}{m}{s}{y}" for d in ["dd", "Dd", "dD", "tt", "jj", "Jj", "jJ"] for m in ["mm", "Mm"] for y in ["yyyy", "jjjj", "aaaa"] for s in "./-"]
    rows = [(x,) for s in words + fields + others for x in {s, s.upper(), s.lower(), s.title()}]
    df = frame("line string", rows)
    slots = df.filter(F.col("line").rlike(slot_pattern()))
    assert [x.line for x in slots.filter(~F.col("line").rlike(slot_mark())).collect()] == []
    # All words in brackets are slots, as are all others in at least one case.
    assert slots.count() > 0.8 * len(rows)


def test_capital_slots_in_round_brackets(frame):
    texts = ["The floor goes to (TBC) for the group.", "The vote (TBA) was close.", "(Insert speaker) has the floor.", "We thank (Fill in) for this.", "Voto (Insertar voto) cerrado.", "Das Wort hat (Einfügen) heute.", "La parole est à (À COMPLÉTER) maintenant.", "Sitting of Jj/Mm/Aaaa here."]
    notes = ["(Applause) Thank you.", "(THE SITTING WAS SUSPENDED) We go on.", "(Confirmed by the clerk) We go on."]
    rows = list(enumerate(texts + notes))
    assert {x.doc_id for x in residue(frame("doc_id bigint, text string", rows)).collect()} == {*range(len(texts))}


def test_empty_table(frame):
    assert residue(frame("doc_id bigint, text string")).count() == 0


def naive_simhash(text):
    h = neardup._grams([text])[0]
    return tuple(sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in part) > len(part)) for part in (h, neardup._mixed(h + np.uint64(0x9E3779B97F4A7C15))))


def test_simhash_equals_the_definition(monkeypatch):
    texts = ["", "a", "abc", "the same text", "ä long one 𝄞 " * 300, "", "x" * 256]
    want = [naive_simhash(t) for t in texts]
    got = lambda: [tuple(int(x) % 2**64 for x in v) for v in simhash_values(texts)]
    assert got() == want and simhash_values([]).shape == (0, 2)
    monkeypatch.setattr(neardup, "CHUNK", 600)
    assert got() == want


def test_labels_spread_over_whole_components(frame):
    r = random.Random(2)
    base = ["".join(r.choice(string.ascii_lowercase + "   ") for _ in range(70)) for _ in range(6)]
    texts = []
    for b in base:
        texts.append(b)
        for _ in range(5):
            b = list(b)
            b[r.randrange(len(b))] = r.choice(string.ascii_lowercase)
            texts.append("".join(b))
    rows = [(i, t, "x" if i % 6 == 0 and i < 30 else None, i < 24) for i, t in enumerate(texts)]
    want, front = {i for i, x in enumerate(rows) if x[2]}, [i for i, x in enumerate(rows) if x[2] and x[3]]
    while front:
        i = front.pop()
        for j in range(len(texts)):
            if j not in want and like(texts[i], texts[j], 0.8):
                want.add(j)
                front.append(j)
    assert [p for p, _ in spread_pids(texts_frame(frame, rows), 40, 0.8)] == sorted(want) and len(want) > 12


def test_many_alike_under_hot_keys(frame, monkeypatch):
    """A third of all texts are alike and ask, another third are alike and unlabelled: all are found, by few pairs, over dealt keys."""
    monkeypatch.setattr(neardup, "HOT_KEY", 50)
    monkeypatch.setattr(neardup, "FIRST", 2)
    r = random.Random(9)
    base = "the record of this sitting is not to be shown at the moment because the service is being looked after"
    near = lambda i: base[: i % 90] + r.choice(string.ascii_lowercase) + base[i % 90 + 1 :] + f" {i}"
    rows = [(i, near(i), "x" if i < 100 else None, i < 100) for i in range(300)] + [(1_000 + i, " ".join(r.choice(["ab", "cde", "fghi", "jk", "lmnop"]) + str(r.randrange(99)) for _ in range(9)), None, False) for i in range(300)]
    df = texts_frame(frame, rows)
    assert hot_keys(tables_of(df)) is not None
    sizes = []
    real = neardup.candidates
    monkeypatch.setattr(neardup, "candidates", lambda *a: sizes.append(real(*a).count()) or real(*a))
    assert [p for p, _ in spread_pids(df, 40, 0.8)] == list(range(300))
    assert sum(sizes) < 100 * 200 / 2


def test_short_and_long_texts_take_part(frame):
    long = "and so we said that it was right to do it again and again " * 3_000
    rows = [(1, "gone", "error", True), (2, "gone", None, False), (3, "go", None, False), (4, "", None, False), (5, long, "filler", True), (6, long + "and so", None, False), (7, "a", None, False)]
    assert spread_pids(texts_frame(frame, rows), 40, 0.8) == [(1, "error"), (2, "error"), (5, "filler"), (6, "filler")]


def test_phrases_need_not_be_rows(frame):
    df = texts_frame(frame, [(1, "please enable javascript to view this transcript", None, False), (2, "the committee has costed the plan", None, False), (3, None, None, False)])
    found = LabelSpread(df, 40, 0.6).go(frame("norm string, label string", [("please enable javascript to view this page", "script"), (None, "x")]))
    assert [(x.pid.a, x.label) for x in found.collect()] == [(1, "script")]
    assert LabelSpread(df.limit(0), 40, 0.6).go(frame("norm string, label string", [("not found", "error")])).count() == 0


def test_alike_wants_equal_lengths(frame):
    df = frame("x string, y string", [("not found", "not found not found not found"), ("page not found", "page not found"), ("page not found", "pages not found"), ("", "")])
    assert [r.y for r in alike(df, "x", "y", 0.6).collect()] == ["page not found", "pages not found", ""]
    assert alike(df, "x", "y", 0.6, F.col("x") == "not found").count() == 4


def test_recall_of_the_tables_against_all_pairs(frame):
    """Pairs of sentences, short ones too, with letters changed, left out and put in: how many with a similarity of 0.6 or more the tables and the Hamming distance find."""
    r = random.Random(8)
    a, b = [], []
    while len(a) < 3_000:
        x = "".join(r.choice(string.ascii_lowercase + "    ") for _ in range(r.randrange(12, 120)))
        y = list(x)
        for _ in range(r.randrange(1, 2 + len(x) // 12)):
            i = r.randrange(len(y))
            y[i : i + r.choice([0, 1, 1, 2])] = r.choice(["", r.choice(string.ascii_lowercase)])
        y = "".join(y)
        if x != y and like(x, y, 0.6):
            a.append(x)
            b.append(y)
    df = frame("x string, y string", list(zip(a, b))).withColumns({"sx": simhash(F.col("x")), "sy": simhash(F.col("y"))}).select("x", hamming(F.col("sx"), F.col("sy")).alias("far"), table_keys(F.col("sy")).alias("keys")).collect()
    found = [r.far <= 40 and bool(set(r.keys) & set(map(int, p))) for r, p in zip(df, probe_values([r.x for r in df]))]
    assert np.mean(found) > 0.9


def test_company_is_learned_from_neighbourhoods(frame):
    """A wording that no phrase is like, beside notices in five different neighbourhoods, is learned, and found where it stands alone; one seen beside a notice once isn't."""
    r = random.Random(7)
    plain = lambda: " ".join(r.choice("the committee has costed plan for winter road clearing and says so with regret because of warnings from town".split()) for _ in range(9))
    odd = "the bulb of the reader is dim until the lever is moved"
    notices = ["Page not found.", "Please try again later.", "Internal Server Error.", "Access denied.", "Too many requests."]
    rows = [(i, f"{plain()}.\n{n}\n{odd}.\n{plain()}.") for i, n in enumerate(notices)]
    rows += [(10, f"{odd}."), (11, "Page not found.\nA word that stands here but once."), (12, "A word that stands here but once.")]
    rows += [(100 + i, f"{plain()}. {plain()}.") for i in range(200)]
    rows += [(400 + i, f"{plain()}.\n{notices[0]}\nThank you for that, my honourable friends.") for i in range(2)] + [(500 + i, f"Thank you for that, my honourable friends. {plain()}.") for i in range(60)]
    got = {x.doc_id for x in residue(frame("doc_id bigint, text string", rows)).collect()}
    assert got == {*range(5), 10, 11, 400, 401}


def test_repeating_documents_changes_nothing(frame):
    """Every document eleven times over: what is found is the same, eleven times over."""
    r = random.Random(5)
    plain = lambda: " ".join(r.choice("the committee has costed plan for winter road clearing and says so with regret because of warnings from town".split()) for _ in range(9))
    texts = [t for ts in FOUND.values() for t in ts] + [t for t in CLEAN if t and len(t) < 1_000] + [f"{plain()}. {plain()}." for _ in range(40)]
    once = {x.doc_id for x in residue(frame("doc_id bigint, text string", list(enumerate(texts)))).collect()}
    often = [(i + 1_000 * k, t) for i, t in enumerate(texts) for k in range(11)]
    assert {x.doc_id for x in residue(frame("doc_id bigint, text string", often)).collect()} == {i + 1_000 * k for i in once for k in range(11)}


def test_without_near_duplicates_most_notices_are_lost(frame, monkeypatch):
    """Phrases label no row by themselves: rows get their labels through the search."""
    rows = [(i, t) for i, t in enumerate(FOUND["script"] + FOUND["error"])]
    df = frame("doc_id bigint, text string", rows)
    monkeypatch.setattr(LabelSpread, "go", lambda self, front: self.texts.select("pid", "norm", F.col("own").alias("label")).limit(0))
    # Bare codes are left.
    assert {x.doc_id for x in residue(df).collect()} == {i for i, t in rows if t in ("Error 503", "Reference: 8842-17")}


def test_long_spans_are_read_whole(frame):
    words = "well that isn't what we'd say " * 2_000
    rows = [(1, f"They told us '{words}Page not found.' and no more"), (2, f'They told us "{words}Page not found." and no more'), (3, "[insert name of the member " + "who spoke " * 200 + "here] has the floor."), (4, "{{" + "a" * 500 + "}}"), (5, "'" * 20_000), (6, "( " * 20_000), (7, "it's " * 50_000 + "'")]
    assert {x.doc_id for x in residue(frame("doc_id bigint, text string", rows)).collect()} == {3, 4}


@pytest.mark.parametrize(("text", "mashed"), [("bla bla bla bla", True), ("klwk kwlk klwk klwk", True), ("the the the the the", False), ("xxx xxxx xxxxx", True), ("abcd efgh ijkl", False), ("one klwk klwk kwlk klwk klwk two", True), ("klwk", False), ("", False)])
def test_mashed(text, mashed):
    assert is_mashed(text.split(" "), frozenset({"the", "one", "two"})) is mashed


def test_character_model_on_held_out_words():
    r = random.Random(1)
    latin = lambda: " ".join("".join(r.choice(["qui", "gra", "ul", "bea", "nu", "est", "or", "um"]) for _ in range(3)) for _ in range(8))
    plain = lambda: " ".join(r.choice("the committee has costed plan for winter road clearing and says so with regret because of warnings from town".split()) for _ in range(8))
    odds, unknown = fit([latin() for _ in range(60)], [plain() for _ in range(300)])
    assert all(score(latin(), odds, unknown) > 1.2 for _ in range(100)) and all(score(plain(), odds, unknown) < 0 for _ in range(100))
