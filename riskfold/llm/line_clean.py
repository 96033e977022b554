"""Line-first cleaning (op 3).

Every line is judged by itself, in this order; a failing line is removed:

* symbols      over a tenth of its non-blank characters are of [#*$%&|<>]
* navigation   two or more menu separators, or few words opening like a menu
* boilerplate  legal, cookie, subscription and licence phrases
* repeated     equal to an earlier line of the document
* punctuation  no mark that ends a sentence at its end

Menu and boilerplate phrases are English, German, French and Spanish (composed
accents); the marks are those of Latin, Arabic, Armenian, Indic, Ethiopic,
Khmer, Burmese and CJK texts, and a line that ends in Thai, Lao or Tibetan
script needs none.  A line without a mark that is wrapped prose stays: it has
WRAPPED word characters or more, passes the first three rules, and so do the
lines directly below it down to one with a mark.

Only then the document is judged: it is rejected when the base checks fail or
the removed lines hold more than MOST_LOST per cent of its word characters, so
a good article keeps its place after losing a menu and a footer.  A removed
repeated line is no loss: its text still stands once.

Defined results: null text is empty (no words: base_failed); lines without a
word are neither removed nor counted; each row is judged by itself (repeated
rows, null doc_ids); an empty table gives no rows; other columns are carried
along, columns named like results are replaced.  Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskfold.llm.registry import register
from riskfold.llm.words import Words, documents, ngrams, slices, texts

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50   # per cent of words in 3-word windows found twice
MOST_LOST = 50       # per cent of word characters in removed lines
MENU_WORDS = 8

WRAPPED = 30         # word characters of a line that may go on in the next one

MENU_SEPARATORS = "[|»›•·]"
# lower-cased openings of menu lines and phrases of boilerplate lines, by language
MENU = {
    "en": ("home", "menu", "login", "log in", "logout", "sign in", "sign up", "register", "search", "next", "previous",
           "back to top", "skip to", "share", "tweet", "print", "read more", "click here", "contact us", "about us",
           "site map", "sitemap", "follow us"),
    "de": ("startseite", "menü", "anmelden", "abmelden", "registrieren", "nach oben", "zum inhalt", "teilen", "drucken",
           "mehr lesen", "weiterlesen", "hier klicken", "kontakt", "impressum", "über uns", "folgen sie uns"),
    "fr": ("accueil", "connexion", "se connecter", "déconnexion", "s'inscrire", "rechercher", "haut de page",
           "aller au contenu", "partager", "imprimer", "lire la suite", "cliquez ici", "contactez-nous",
           "nous contacter", "plan du site", "suivez-nous"),
    "es": ("inicio", "menú", "iniciar sesión", "cerrar sesión", "registrarse", "buscar", "volver arriba",
           "ir al contenido", "compartir", "imprimir", "leer más", "haga clic aquí", "contáctenos", "quiénes somos",
           "mapa del sitio", "síguenos"),
}
BOILERPLATE = {
    "en": ("all rights reserved", "copyright", "©", "cookie", "privacy policy", "terms of use", "terms of service",
           "subscribe to", "newsletter", "unsubscribe", "enable javascript", "powered by", "licensed under",
           "released under the", "lorem ipsum"),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "allgemeine geschäftsbedingungen",
           "jetzt abonnieren", "abonnieren sie", "javascript aktivieren", "javascript zu aktivieren", "lizenziert unter"),
    "fr": ("tous droits réservés", "politique de confidentialité", "conditions d'utilisation",
           "conditions générales d'utilisation", "mentions légales", "abonnez-vous", "se désabonner", "désinscrivez-vous",
           "activer javascript", "activez javascript", "propulsé par", "publié sous licence"),
    "es": ("todos los derechos reservados", "política de privacidad", "condiciones de uso", "términos de uso",
           "aviso legal", "suscríbete", "suscríbase", "darse de baja", "activar javascript", "active javascript",
           "con la tecnología de", "publicado bajo licencia"),
}
SENTENCE_END = (r"""[.!?:;…"'”’»)\]"""     # Latin
                "؟۔؛։।॥።፧፨។။"             # Arabic, Armenian, Indic, Ethiopic, Khmer, Burmese
                "。．｡！？：；」』）】》〉"   # CJK
                "ก-๛ກ-ໟༀ-࿿]$")             # Thai, Lao, Tibetan: any character of the script

_PHRASES = tuple(p for language in BOILERPLATE.values() for p in language)
_MENU_SEPARATORS, _END = re.compile(MENU_SEPARATORS), re.compile(SENTENCE_END)
_MENU = re.compile("[^a-zà-ÿ]*(%s)($|[^a-zà-ÿ])" % "|".join(
    re.escape(w) for w in dict.fromkeys(w for language in MENU.values() for w in language)))
RULES = ("symbols", "navigation", "boilerplate", "repeated", "punctuation")


_split = re.compile(f"[^{BLANKS}]+").findall


def failing_rule(line: str, lower: str, words: list[str], phrases: list[str]) -> str | None:
    """The first of the three rules on what a line says that it fails."""
    if 10 * sum(map(line.count, SYMBOLS)) > sum(map(len, words)):
        return "symbols"
    if (len(words) <= MENU_WORDS and _MENU.match(lower)) or len(_MENU_SEPARATORS.findall(line)) >= 2:
        return "navigation"
    if any(p in lower for p in phrases):
        return "boilerplate"
    return None


def clean(text: str) -> tuple[str, int, int, int, list[int]]:
    """Kept text, word characters, those removed, duplicate lines, lines removed by rule."""
    lines, lower = text.split("\n"), text.lower()
    phrases = [p for p in _PHRASES if p in lower]
    words = [_split(line) for line in lines]
    sizes = [sum(map(len, w)) for w in words]
    rules = [failing_rule(line, low, w, phrases) if w else None for line, low, w in zip(lines, lower.split("\n"), words)]
    # from the last line up: whether a sentence ends here or in the lines directly below
    ends, below = [False] * len(lines), False
    for i in range(len(lines) - 1, -1, -1):
        below = bool(words[i]) and rules[i] is None and (
            _END.search(lines[i].rstrip(BLANKS)) is not None or (below and sizes[i] >= WRAPPED))
        ends[i] = below
    seen: set[str] = set()
    kept, lost, repeats, by_rule = [], 0, 0, [0] * len(RULES)
    for line, n, rule, end in zip(lines, sizes, rules, ends):
        if not n:
            kept.append(line)
            continue
        again = line in seen
        seen.add(line)
        repeats += again
        rule = rule or ("repeated" if again else None if end else "punctuation")
        if rule is None:
            kept.append(line)
        else:
            lost += n if rule != "repeated" else 0  # its text still stands once
            by_rule[RULES.index(rule)] += 1
    return "\n".join(kept), sum(sizes), lost, repeats, by_rule


def repeated_words(words: Words) -> np.ndarray:
    """Words of each row that lie in 3-word windows found twice or more in it."""
    h = ngrams(words.hashes, 3)
    out = np.zeros(len(words.first) - 1, dtype=np.int64)
    at = np.flatnonzero(words.row[:len(h)] == words.row[2:]) if len(h) else np.zeros(0, np.int64)
    if not len(at):
        return out
    key, row = h[at], words.row[at]
    order = np.lexsort((key, row))
    key, row, at = key[order], row[order], at[order]
    same = (key[1:] == key[:-1]) & (row[1:] == row[:-1])
    twice = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    covered = np.zeros(len(words.hashes) + 2, dtype=bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return out + np.bincount(words.row[covered[:len(words.hashes)]], minlength=len(out))


RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "lost_chars long, kept boolean, kept_text string, " + ", ".join(f"lines_{r} int" for r in RULES))


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` plus the columns of RESULT."""
    result = StructType.fromDDL(RESULT)
    docs = docs.drop(*result.names)
    columns = docs.columns
    inner = [f"c{i}" for i in range(len(columns))]
    text = inner[columns.index("text")]
    renamed = docs.toDF(*inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            rows = texts(part, text)
            words = Words(rows)
            n_words, n_repeat = np.diff(words.first), repeated_words(words)
            cleaned = [clean(t) for t in rows]
            chars = np.array([c[1] for c in cleaned])
            lost = np.array([c[2] for c in cleaned])
            failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
            results = [
                pa.array(n_words, pa.int64()), pa.array(chars, pa.int64()),
                pa.array([sum(map(t.count, SYMBOLS)) for t in rows], pa.int64()),
                pa.array([c[3] for c in cleaned], pa.int64()), pa.array(n_repeat, pa.int64()), pa.array(failed),
                pa.array(lost, pa.int64()), pa.array(~failed & (100 * lost <= MOST_LOST * chars)),
                pa.array([c[0] for c in cleaned], pa.string()),
                *(pa.array([c[4][k] for c in cleaned], pa.int32()) for k in range(len(RULES)))]
            yield pa.RecordBatch.from_arrays([*part.columns, *results], names=[*inner, *result.names])

    out = renamed.mapInArrow(run, StructType(renamed.schema.fields + result.fields))
    return out.select(*(F.col(i).alias(c) for i, c in zip(inner, columns)), *result.names)


# the rules once more, written for SQL
_ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, i, string_split(t, chr(10))[i] AS line FROM d, unnest(range(1, len(string_split(t, chr(10))) + 1)) u(i)),
w AS (
  SELECT *, len(array_to_string(lw, '')) AS chars, lower(line) AS low
  FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM l)),
f AS (
  SELECT *, 10 * len(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > chars
      OR len(regexp_extract_all(line, '[|»›•·]')) >= 2
      OR (len(lw) <= {MENU_WORDS} AND regexp_matches(low, '^[^a-zà-ÿ]*('
        || 'home|menu|login|log in|logout|sign in|sign up|register|search|next|previous|back to top|skip to|share|tweet|print|'
        || 'read more|click here|contact us|about us|site map|sitemap|follow us|'
        || 'startseite|menü|anmelden|abmelden|registrieren|nach oben|zum inhalt|teilen|drucken|mehr lesen|weiterlesen|'
        || 'hier klicken|kontakt|impressum|über uns|folgen sie uns|'
        || 'accueil|connexion|se connecter|déconnexion|s''inscrire|rechercher|haut de page|aller au contenu|partager|imprimer|'
        || 'lire la suite|cliquez ici|contactez-nous|nous contacter|plan du site|suivez-nous|'
        || 'inicio|menú|iniciar sesión|cerrar sesión|registrarse|buscar|volver arriba|ir al contenido|compartir|leer más|'
        || 'haga clic aquí|contáctenos|quiénes somos|mapa del sitio|síguenos)($|[^a-zà-ÿ])'))
      OR regexp_matches(low, 'all rights reserved|copyright|©|cookie|privacy policy|terms of (use|service)|subscribe to|'
        || 'newsletter|unsubscribe|enable javascript|powered by|licensed under|released under the|lorem ipsum|'
        || 'alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|allgemeine geschäftsbedingungen|'
        || 'jetzt abonnieren|abonnieren sie|javascript (zu )?aktivieren|lizenziert unter|'
        || 'tous droits réservés|politique de confidentialité|conditions (générales )?d''utilisation|mentions légales|'
        || 'abonnez-vous|se désabonner|désinscrivez-vous|active[rz] javascript|propulsé par|publié sous licence|'
        || 'todos los derechos reservados|política de privacidad|(condiciones|términos) de uso|aviso legal|'
        || 'suscr(íbete|íbase)|darse de baja|activ(ar|e) javascript|con la tecnología de|publicado bajo licencia') AS bad,
    regexp_matches(regexp_replace(line, '[\x20\x09-\x0D]+$', ''),
      '[.!?:;…"''”’»)\]؟۔؛։।॥።፧፨។။。．｡！？：；」』）】》〉ก-๛ກ-ໟༀ-࿿]$') AS mark
  FROM w),
e AS (  -- the first line from here on that cannot go on in the next: does a sentence end in it?
  SELECT *, coalesce(min(CASE WHEN len(lw) = 0 OR bad OR mark OR chars < {WRAPPED} THEN 2 * i + CASE WHEN len(lw) > 0 AND NOT bad AND mark THEN 1 ELSE 0 END END)
    OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) % 2, 0) = 1 AS ends FROM f),
j AS (
  SELECT *, bad OR (NOT dup AND NOT ends) AS gone
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup FROM e WHERE len(lw) > 0)),
s AS (SELECT doc_id, sum(chars) AS chars, sum(CASE WHEN gone THEN chars ELSE 0 END) AS lost, count(*) FILTER (dup) AS dups FROM j GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 1, 1))) u(i)),
r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), unnest(range(0, 3)) v(k)
  WHERE c > 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(s.chars, 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(s.dups, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  len(ws) < {LEAST_WORDS} OR 100 * coalesce(r.n, 0) > {MOST_REPEATED} * len(ws) AS base_failed,
  NOT (len(ws) < {LEAST_WORDS} OR 100 * coalesce(r.n, 0) > {MOST_REPEATED} * len(ws)) AND 100 * coalesce(s.lost, 0) <= {MOST_LOST} * coalesce(s.chars, 0) AS kept,
  CAST(coalesce(s.lost, 0) AS BIGINT) AS lost_chars
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)
"""


@register("op3_line_clean", _ORACLE)
def op3_line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
