"""Operator 6, quality rules: line-first cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_like, table

#: A line fails if separators of menus are at least so many a word ...
NAV_MARKS, NAV_SHARE = "|»›•", 0.2
#: ... or symbols, or doubled exclamation marks (three at least) ...
SYMBOLS, SYMBOL_SHARE = "#$%&*~^<>{}\\", 0.5
SHOUT_SHARE, SHOUT_LEAST = 0.3, 3
#: ... or if so large a share of its words (of so many at least) repeat the word before ...
STUTTER_SHARE, STUTTER_WORDS = 0.3, 6
#: ... or if so long a line has no sentence mark at all ...
UNMARKED_WORDS = 15
SENTENCE_MARKS = "[.!?…。！？।؟:;]"
#: ... or if a line of at most so many words holds a phrase of page furniture, in one of the corpus' four languages.
BOILERPLATE_WORDS = 25
#: A phrase begins a word, which also spares a look at most places of a line.
BOILERPLATE = (
    "(^|[^a-z])(all rights reserved|accept (all )?cookies|cookie (policy|settings)|privacy policy|terms of (use|service)"
    "|subscribe to our newsletter|sign up for our|enable javascript|javascript is (disabled|required)|click here"
    "|skip to (main )?content|back to top|share (this )?on (facebook|twitter)|lorem ipsum|powered by wordpress"
    "|alle rechte vorbehalten|cookies? akzeptieren|datenschutz(erklärung|bestimmungen)|nutzungsbedingungen|newsletter abonnieren"
    "|javascript aktivieren|hier klicken|zum inhalt springen|nach oben springen"
    "|tous droits réservés|accepter (tous )?les cookies|politique de (confidentialité|cookies)|conditions d.utilisation|abonnez-vous à notre"
    "|activer javascript|cliquez ici|aller au contenu|haut de page"
    "|todos los derechos reservados|aceptar (todas )?(las )?cookies|política de (privacidad|cookies)|(términos|condiciones) de uso"
    "|suscríb[ae](te|se) a nuestr|habilit[ae] javascript|ha(z|ga) clic aquí|saltar al contenido|volver arriba)"
)
#: A document goes if it keeps less than this share of its characters.
KEEP_SHARE = 0.5


def _sql(filter_: str, split: str, length: str, count: str, previous: str, matches: str) -> str:
    """The test of a line ``l`` with words ``w``, in either dialect."""
    gone = lambda marks: f"({length}(l) - {length}(translate(l, '{marks}', '')))"
    return (
        f"NOT ({count}(w) > 0 AND ("
        f"{gone(NAV_MARKS)} >= {NAV_SHARE} * {count}(w) AND {gone(NAV_MARKS)} > 0"
        f" OR {gone(SYMBOLS)} >= {SYMBOL_SHARE} * {count}(w)"
        f" OR ({length}(l) - {length}(replace(l, '!!', ''))) / 2 >= greatest({SHOUT_SHARE} * {count}(w), {SHOUT_LEAST})"
        f" OR {count}(w) >= {STUTTER_WORDS} AND {previous} >= {STUTTER_SHARE} * {count}(w)"
        f" OR {count}(w) >= {UNMARKED_WORDS} AND NOT {matches.format('l', SENTENCE_MARKS)}"
        f" OR {count}(w) <= {BOILERPLATE_WORDS} AND {matches.format('lower(l)', BOILERPLATE)}))"
    )


def clean_lines(docs: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The documents that survive, with the lines that failed a rule removed.

    Each line is judged alone: menu separators, symbols and shouting (punctuation), stuttered
    words, long lines without a sentence mark, and page furniture. Then a document that keeps less
    than ``keep_share`` of its characters (white space not counted) goes. Blank lines are kept and
    don't count. ``n_chars`` becomes the length of what is left. Documents whose text is null,
    empty or white space go: they have nothing to keep. Nulls in other columns stay; repeated rows
    are judged alike; columns other than those of ``documents`` are dropped.
    """
    line = _sql("filter", "split", "length", "size", "size(filter(w, (x, i) -> i > 0 AND x = w[i - 1]))", "{} rlike '{}'").replace("\\", "\\\\")
    words = r"filter(split(l, '[ \\t\\n\\x0b\\f\\r]+'), x -> x <> '')"
    kept = f"filter(split(text, '\\n', -1), l -> exists(array({words}), w -> {line}))"
    solid = lambda c: F.length(F.regexp_replace(c, r"[ \t\n\x0b\f\r]+", ""))
    # a generator, so that the filter isn't pushed below it and the lines aren't judged again for each use
    once = documents_like(docs).select("*", F.explode(F.array(F.array_join(F.expr(kept), "\n"))).alias("_kept"))
    cleaned = once.where((solid("text") > 0) & (solid("_kept") >= keep_share * solid("text")))
    return cleaned.select("doc_id", F.col("_kept").alias("text"), "lang", "source", F.length("_kept").cast("bigint").alias("n_chars"))


def op6_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents"))


_LINE = _sql(
    "list_filter", "regexp_split_to_array", "length", "len", "len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1]))", "regexp_matches({}, '{}')"
)
_SOLID = r"length(regexp_replace({}, '[ \t\n\x0b\f\r]+', '', 'g'))"


def oracle(docs: str = "documents") -> str:
    words = r"list_filter(regexp_split_to_array(l, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"
    kept = f"list_filter(string_split(text, chr(10)), lambda l: len(list_filter([{words}], lambda w: {_LINE})) > 0)"
    return f"""
SELECT doc_id, kept AS text, lang, source, length(kept)::BIGINT AS n_chars
FROM (SELECT doc_id, text, lang, source, array_to_string({kept}, chr(10)) AS kept FROM {docs})
WHERE {_SOLID.format('text')} > 0 AND {_SOLID.format('kept')} >= {KEEP_SHARE} * {_SOLID.format('text')}
"""
