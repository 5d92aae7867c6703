import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm.canonical import canonical_array, look_alike_groups, look_alike_pairs
from leafmill.llm.encoding import implausibility, restore, restored, restore_encoding
from leafmill.llm.markup import clean_markup, strip_markup
from leafmill.llm.scan_noise import Decoder, repair, repair_scans
from leafmill.llm.split import split_oversized, split_text

FRENCH = "Même très dégradée, la fenêtre répète déjà la mémoire élargie côté serveur. "
RUSSIAN = "Сначала верхний индекс передаёт каждый раздел за девять шагов. "
CHINESE = "我们发现，自适应的定时器通常比定时器更早转发会话。如果分区超过三百条，请先转发管道。"
GERMAN = "Größere Werte für die Brücke machen jede Verzögerung zur späten Prüfung. "


@pytest.mark.parametrize(
    ("text", "read_as", "meant"),
    [
        (FRENCH, "cp1252", "utf-8"), (GERMAN, "latin-1", "utf-8"), (FRENCH, "mac_roman", "utf-8"), (FRENCH, "cp437", "utf-8"), (FRENCH, "cp1250", "utf-8"),
        (GERMAN, "cp437", "cp1252"), (GERMAN, "mac_roman", "cp1252"), (RUSSIAN, "cp1251", "utf-8"), (RUSSIAN, "latin-1", "utf-8"), (RUSSIAN, "cp1252", "cp1251"),
        (RUSSIAN, "koi8_r", "cp1251"), (CHINESE, "latin-1", "utf-8"), (FRENCH, "gbk", "utf-8"),
    ],
)
def test_encoding_round_trip(text, read_as, meant):
    garbled = text.encode(meant).decode(read_as, "ignore")
    got, flag = restore(garbled)
    assert flag
    if len(garbled.encode(read_as, "ignore")) == len(text.encode(meant)):
        assert got.strip() == text.strip()


def test_encoding_twice_and_in_a_stretch():
    twice = FRENCH.encode().decode("latin-1").encode().decode("latin-1")
    assert restore(twice)[0] == FRENCH
    mixed = GERMAN + FRENCH.encode().decode("latin-1") + GERMAN
    assert restore(mixed)[0] == GERMAN + FRENCH + GERMAN


@pytest.mark.parametrize("text", [FRENCH, RUSSIAN, CHINESE, GERMAN, "", None, "plain", "ŁÓDŹ – SKŁAD ÐRAFT.", "MAÇÃ and ÃGUA", "Ångström and Ærø", "Σ, Ω and √2", "5 € (± 3 %)", "trafﬁc", "x" * 50_000])
def test_encoding_leaves_clean_text(text):
    assert restore(text) == (text, False)


def test_encoding_lost_characters():
    assert restore("Eine Br�cke mit Eintr�gen")[1]
    assert implausibility(FRENCH) == 0


def test_encoding_frame(spark):
    rows = [(1, None), (2, ""), (3, FRENCH.encode().decode("latin-1")), (3, FRENCH.encode().decode("latin-1"))]
    got = restore_encoding(spark.createDataFrame(rows, "node_no long, text string")).collect()
    assert sorted((r.node_no, r.garbled) for r in got) == [(1, False), (2, False), (3, True), (3, True)]
    assert restore_encoding(spark.createDataFrame([], "node_no long, text string")).count() == 0


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("<h2 id='a'>Title</h2><p>One &amp; two<br>three</p>", "## Title\nOne & two\nthree"), ("A **bold** and *slanted* word", "A bold and slanted word"),
        ("see [the page](https://x.example/a) now", "see the page now"), ("''it'' and '''bold''' and [[Page|link]]", "it and bold and link"),
        ("== Heading ==\ntext", "## Heading\ntext"), (r"\section{Start} a \emph{word}.~\cite{b}", "# Start\n a word."), ("Head\n====\n\ntext", "# Head\n\ntext"),
        ("<pre><code>if a &lt; b:\n    c</code></pre>", "```\nif a < b:\n    c\n```"), ("| a | b |\n|---|---|\n| 1 | 2 |", "a | b\n1 | 2"), (r"\( x^2 \) is", "$x^2$ is"), ("&amp;lt;b&amp;gt; x", "x"),
        ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", "A | B\n1 | 2"), ("before<script>var q = 1 < 2;</script> after", "before after"),
    ],
)
def test_markup(text, clean):
    got, n = clean_markup(text)
    import re

    assert n > 0 and re.sub(r"\n{2,}", "\n", got.strip()) == re.sub(r"\n{2,}", "\n", clean)


@pytest.mark.parametrize("text", ["a < b and c > d", "costs $5, two cost $9", "3 * 4 * 5", "-> or =>", r"C:\temp\logs is", "list[0] and map{k}", "max_size and a_b_c", "Rule #3 for C#", "R&D and AT & T", "• first\n• second", "3/4 ~ 0.75", "2^10 entries | at most", "if (n<3 && m>4) then", "", None, "x" * 40_000])
def test_markup_leaves_plain_text(text):
    assert clean_markup(text) == (text, 0)


def test_markup_keeps_code_and_frame(spark):
    code = "```python\na = b * c  # **no**\n```"
    assert clean_markup(f"**x**\n\n{code}")[0] == f"x\n\n{code}"
    got = strip_markup(spark.createDataFrame([(1, None), (2, "<b>x</b>"), (3, "")], "node_no long, text string")).collect()
    assert sorted((r.node_no, r.pieces > 0) for r in got) == [(1, False), (2, True), (3, False)]


def test_encoding_layers_and_confidence():
    for garbled, text in (
        ("café et thé".encode("cp1252").decode("cp437").encode().decode("latin-1"), "café et thé"),
        (GERMAN.encode().decode("cp1252", "ignore").encode().decode("cp1252", "ignore"), None),
        ("我们发现定时器".encode("gb18030").decode("latin-1"), "我们发现定时器"),
    ):
        got, flag, sure = restored(garbled)
        assert flag and 0.5 < sure <= 1 and text in (None, got)
    assert restored("lost \ufffd\ufffd text")[1:] == (True, 0.0) and restored("Größe")[2] is None and restored("INSTALAÇÃO E")[1] is False


def check_split(text, limit, overlap):
    cuts = split_text(text, limit, overlap)
    assert cuts[0][:2] == (0, 0) and cuts[-1][2] == len(text)
    for (s, f, e), after in zip(cuts, [*cuts[1:], None]):
        assert 0 <= s <= f < e or len(text) == 0
        assert e - s <= limit and f - s <= overlap
        if after:
            assert after[1] == e and after[0] > s
    assert "".join(text[f:e] for _, f, e in cuts) == text
    return cuts


def test_split_random_texts():
    r = random.Random(3)
    for n in range(60):
        text = "".join(r.choice(["word ", "longer", " ", ". ", ", ", "\n", "\n\n", "。", "x" * r.randint(1, 300)]) for _ in range(r.randint(0, 900)))
        check_split(text, r.choice([50, 200, 1536]), r.choice([0, 20, 60]))
    check_split("y" * 10_000, 2048, 400)
    check_split("", 10, 3)


def test_split_at_natural_boundaries():
    text = "\n\n".join("This is a sentence of some length. " * 9 for _ in range(20)).strip()
    cuts = check_split(text, 2048, 400)
    assert all(text[:e].rstrip().endswith(".") for _, _, e in cuts)
    assert all(f > s for s, f, _ in cuts[1:])


def test_split_frame(spark):
    rows = [(1, "a b " * 400, "Table 3"), (2, "a b " * 400, None), (3, None, "x"), (4, "a b " * 600, None), (4, "a b " * 600, None)]
    got = split_oversized(spark.createDataFrame(rows, "node_no long, text string, section_header string")).select("node_no").distinct().collect()
    assert sorted(r.node_no for r in got) == [1, 4]


def test_scan_decoder():
    d = Decoder(frozenset("the filter reads every node before manifest splits it operators rarely notice transmission of".split()))
    text = "Chapter 3  Dense Filter    44\nThe fi1ter reads every n0de befo-\nre the rnanifest sp1its it. Operators rarely no¬\ntice transrnission of the fil-\nter.\n\n44 |"
    fixed, gone, joined, wrong = repair(text, {44}, d)
    assert (gone, joined) == (2, 3) and wrong >= 4
    assert fixed == "The filter reads every node before the manifest splits it. Operators rarely notice transmission of the filter."


@pytest.mark.parametrize(
    ("noisy", "clean"),
    [
        ("infor-\nma-\ntion", "information"), ("in- \nfor-\nmation", "information"), ("thenetworksignal", "the network signal"), ("netw0rkis", "network is"),
        ("retum", "return"), ("inforrnation", "information"), ("sig-\nna1", "signal"), ("Retum", "Return"), ("infor ma tion", "information"), ("signaI_x", "signaI_x"),
    ],
)
def test_scan_lattice(noisy, clean):
    d = Decoder(frozenset("information the network signal is return".split()))
    assert repair(noisy, set(), d)[0] == clean


def test_scan_headings_need_repetition(spark):
    """A line that looks like a running header leaves where it comes on two nodes of a document, misread or not."""
    body = "The filter reads every node before the manifest splits it again here.\nOperators rarely notice the slow transmission of all these many records."
    rows = [(1, "d", f"A short heading\n{body}"), (2, "e", f"Runn1ng Title\n{body}"), (3, "e", f"Running Title\n{body}"), (4, None, f"Running Title\n{body}")]
    rows += [(10 + k, "x", "the filter reads every node running title") for k in range(4)]
    df = spark.createDataFrame([(n, d, t, "a.pdf" if n < 10 else "a.txt", None, None) for n, d, t in rows], "node_no long, doc_id string, text string, file_name string, page int, page_numbers array<int>").withColumn("source", F.col("file_name"))
    got = {r.node_no: r for r in repair_scans(df).collect()}
    assert {n: r.furniture for n, r in got.items()} == {1: 0, 2: 1, 3: 1, 4: 0}
    assert got[1].repaired.startswith("A short heading")


def test_scan_decoder_is_linear_in_hostile_words():
    import time

    d, began = Decoder(frozenset("the network signal".split())), time.time()
    for t in ("x" * 200_000, "thenetwork" * 5_000, "-\nab" * 20_000, "rnii1l" * 20_000):
        repair(t, set(), d)
    assert time.time() - began < 20


def test_scan_leaves_clean_pages():
    d = Decoder(frozenset(["words"]))
    for t in ["Lines of a page that are\nonly broken somewhere in\nthe middle of things.", "(1) One thing.\n(2) Other thing.", "x" * 30_000, "", None, "=" * 5000]:
        assert repair(t, {3}, d)[1:] == (0, 0, 0)


def test_scan_frame(spark):
    rows = [(1, "The wh1te house\nstands whi-\nte.", "a.pdf", 3), (2, "white " * 5, "a.txt", None), (3, None, "b.pdf", None), (4, "plain", None, None)]
    df = spark.createDataFrame([(i, t, f, None, p, [p] if p else None) for i, t, f, p in rows], "node_no long, text string, file_name string, source string, page int, page_numbers array<int>")
    got = {r.node_no: r for r in repair_scans(df).collect()}
    assert set(got) == {1} and got[1].joined == 1 and got[1].confusions == 1


def canonical(*texts):
    return canonical_array(pa.array(texts, pa.string())).to_pylist()


def test_canonical_letters_of_other_scripts():
    for a, b in [("ɑꓮᏚ", "aAS"), ("Ⅿⅸ", "Mⅸ"), ("ραυ", "pau"), ("ΑΒ", "AB"), ("λόγος", "λόγoς"), ("5 µA", "5 μA")]:
        x, y = canonical(a, b)
        assert x == y, (a, b)
    assert canonical("λόγος") == ["λόγος"] and canonical("μA") == ["μA"] and canonical("a1", "a2")[0] != canonical("a1", "a2")[1]


def test_canonical_forms():
    same = [("ＡＢＣ１２３．", "ABC123."), ("conﬁg ﬂow", "config flow"), ("cafe\u0301", "café"), ("a\u200bb\ufeff\u00adc", "abc"), ("a\u00a0b\u2007c\u202fd", "a b c d"), ("well\u2010known\u2011x", "well-known-x"), ("сосо", "coco"), ("Κ\u212a", "KK"), ("\u212b\u2126µ", "Å\u03a9μ"), ("ŕ\u0323", "r\u0323\u0301"), ("한글", "\u1112\u1161\u11ab\u1100\u1173\u11af"), ("вeктор", "вектор")]
    for a, b in same:
        x, y = canonical(a, b)
        assert x == y, (a, b, x, y)
    other = [("1", "2"), ("a", "A"), ("é", "e"), ("a b", "a\nb"), ("x²", "x2"), ("a", "ab"), ("½", "1/2")]
    for a, b in other:
        x, y = canonical(a, b)
        assert x != y
    assert canonical(None, "", "x") == [None, "", "x"]
    assert canonical("вектор ёж") == ["вектор ёж"]


def test_canonical_is_stable_and_matches_the_database():
    import unicodedata

    r = np.random.default_rng(1)
    pool = [*range(0x20, 0x250), *range(0x300, 0x340), *range(0x390, 0x500), *range(0x1E00, 0x2000), *range(0xAC00, 0xAC80)]
    texts = ["".join(chr(c) for c in r.choice(pool, r.integers(0, 60))) for _ in range(400)]
    once = canonical(*texts)
    assert canonical(*once) == once
    assert all(unicodedata.normalize("NFC", t) == t for t in once if not any("Ͱ" <= c < "԰" for c in t))
    assert canonical(*(unicodedata.normalize("NFD", t) for t in texts)) == once


def test_look_alike_pairs(spark):
    rows = [(1, "the cat"), (2, "the c\u0430t"), (3, "the cat"), (4, None), (5, ""), (6, "\u200b"), (2, "the c\u0430t"), (7, "The cat")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, id int")
    assert {tuple(r) for r in look_alike_pairs(df).collect()} == {(1, 2), (2, 3), (5, 6)}
    assert {tuple(r) for r in look_alike_groups(df).collect()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (5, 5, 2), (6, 5, 2), (7, 7, 1)}
