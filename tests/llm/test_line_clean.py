import re
from collections import Counter

import duckdb
import pandas as pd
import regex

from riskfold.llm import line_clean as L
from riskfold.llm.words import documents
from conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    ws = WORD.findall(t)
    grams = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(covered),
            len(ws) < 50 or 100 * len(covered) > 50 * len(ws))


def run(df):
    return {r.doc_id: r for r in L.judge(df).collect()}


GOOD = " ".join(f"word{i}" for i in range(60)) + "."


def test_base_columns_equal_brute_force(spark):
    docs = documents(spark, SF_SMALL).collect()
    out = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                 for r in L.op3_line_clean(spark, SF_SMALL).collect())
    assert out == sorted((d.doc_id, *base(d.text)) for d in docs)


def test_every_rule_and_the_document_verdict(spark):
    texts = {
        1: GOOD,
        2: GOOD + "\nHome | About | Contact\nSign in\nAll rights reserved.\nno end here\n### *** $$$ %%%.",
        3: "\n".join(f"w{i} x{i} never ends y{i}" for i in range(40)),
        4: GOOD + "\n" + "\n".join(["The same line again and again."] * 5),
        5: "a b c " * 40 + ".",
        6: None, 7: "", 8: " \n\t\n", 9: GOOD.replace(" ", "\n"),
        10: "Äpfel – größer als « 10 » ! " * 1 + GOOD + "\n" + GOOD.upper().replace("WORD", "É"),
        11: "\n".join(f"Sentence w{i} x{i} stands y{i} here." for i in range(30000)),
    }
    rows = [(i, t, 5, "x") for i, t in texts.items()] + [(1, GOOD, 6, "y"), (None, GOOD, 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, c1 string")
    all_rows = L.judge(df).collect()
    assert len(all_rows) == len(rows) and "c1" in L.judge(df).columns
    out = {r.doc_id: r for r in all_rows}
    for i, t in texts.items():
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), i
    assert [i for i in texts if out[i].kept] == [1, 2, 4, 10, 11]
    two = out[2]
    assert two.kept_text == GOOD
    assert (two.lines_navigation, two.lines_boilerplate, two.lines_punctuation, two.lines_symbols, two.lines_repeated) == (1, 1, 1, 2, 0)  # symbols are asked first, and the menu bar is a symbol
    assert out[4].lines_repeated == 4 and out[4].lost_chars == 0
    assert not out[3].kept and not out[3].base_failed and out[3].kept_text == ""
    assert out[None].kept
    assert L.judge(df.limit(0)).count() == 0


PROSE = {  # wrapped lines, marks of their own, none where the script has none
    "en": "The river had risen for several days before\nanyone in the village thought of moving the\ncattle to the higher ground beyond the mill.",
    "de": "Der Fluss war schon seit einigen Tagen gestiegen,\nbevor jemand im Dorf daran dachte, das Vieh auf die\nhöher gelegene Weide hinter der Mühle zu bringen.",
    "zh": "河水已经上涨了好几天。\n村里没有人想到要把牛群赶到高处去。\n后来大家都走了！",
    "hi": "नदी कई दिनों से बढ़ रही थी।\nगाँव में किसी ने नहीं सोचा था।",
    "ar": "ارتفع النهر منذ عدة أيام.\nهل فكر أحد في القرية؟",
    "th": "แม่น้ำเพิ่มขึ้นหลายวันแล้ว\nไม่มีใครในหมู่บ้านคิด",
    "am": "ወንዙ ለብዙ ቀናት ከፍ ብሏል።",
}
BOILER = ["Tous droits réservés.", "Abonnez-vous à notre lettre.", "Alle Rechte vorbehalten.", "JETZT ABONNIEREN!",
          "Todos los derechos reservados.", "Consulte nuestra política de privacidad.", "We use COOKIES.", "Mentions légales."]
MENUS = ["Startseite :", "Über uns!", "Accueil »", "Plan du site.", "Quiénes somos?", "Síguenos: a b c.", "Sign in…", "MENÜ:"]
PLAIN = ["Homely houses stood there.", "Kontaktlos zahlte er.", "Menús del día había muchos.", "Partagerons-nous le pain ?", "Énext stood there."]


def test_scripts_wrapped_prose_and_four_languages():
    for name, text in PROSE.items():
        assert L.clean(text)[0] == text and L.clean(text)[2] == 0, name
    for line in BOILER:
        assert L.clean(line)[4][2] == 1, line
    for line in MENUS:
        assert L.clean(line)[4][1] == 1, line
    for line in PLAIN:
        assert L.clean(line)[0] == line, line
    open_line = "this line has enough characters to be a wrapped one"
    for text, left in ((f"{open_line}\nand ends here.", 2), (f"{open_line}\n\nand ends here.", 1), (f"{open_line}\nshort one\nand ends here.", 1),
                       (f"{open_line}\nAll rights reserved.", 0), (f"{open_line}\n{open_line}", 0), (f"{open_line}\n{open_line} too\nend.\n", 3)):
        assert sum(map(bool, L.clean(text)[0].split("\n"))) == left, text
    # every mark of the list ends a sentence, closes a quotation or a part of one
    assert all(regex.match(r"[\p{STerm}\p{Pe}\p{Pf}\p{Po}]", c) for c in L.SENTENCE_END[1:L.SENTENCE_END.index("ก")] if c != "\\")


def test_oracle_on_odd_lines(spark):
    """The oracle holds the rules in its own words."""
    words = " ".join(f"w{i}" for i in range(60)) + "."
    lines = [*PROSE.values(), *BOILER, *MENUS, *PLAIN, "a | b | c", "### *** $$$", "open line of more than thirty characters", "short", "", " \t", words]
    docs = [(i, "\n".join(lines[(i * 7 + k * (1 + i % 5)) % len(lines)] for k in range(i % 11))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, words + "\n" + "\n".join(lines) * 3)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"]
    expected = con.sql(f"SELECT {', '.join(names)} FROM ({L._ORACLE})").fetchall()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, L.judge(df).select(*names).collect())) == sorted(expected)
