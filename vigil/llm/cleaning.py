"""Line-first cleaning with DataFrame functions only (no Python on the executors).

Rules look at one line at a time; lines that fail go, then a document that lost too much of its text is
rejected. A line with a word fails if

* *punctuation*: signs of ``#*$%&|<>`` or ``!`` and ``?`` are more than ``sign_share`` of its characters
  without blanks, or it has ``{`` or ``}``;
* *navigation*: it has ``nav_bars`` or more cells parted by ``|``, ``»``, ``·`` or ``›``, or it is one of
  the usual menu labels;
* *boilerplate*: it holds one of the phrases in ``BOILERPLATE``;
* *repetition*: it equals an earlier line of the document.

Counts of a text are made within its row: no shuffle, no explosion, memory in proportion to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
SIGNS = r"[#*$%&|<>]+"
# Phrases of page furniture, and menu labels, in lower case (English, German, French, Spanish).
BOILERPLATE = (
    "javascript", "lorem ipsum", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "uses cookies", "use cookies", "all rights reserved", "click here", "sign up for our", "subscribe to our",
    "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "verwendet cookies", "hier klicken", "newsletter abonnieren",
    "politique de confidentialité", "conditions générales", "tous droits réservés", "utilise des cookies", "cliquez ici", "abonnez-vous",
    "política de privacidad", "términos de uso", "todos los derechos reservados", "utiliza cookies", "haga clic aquí", "suscríbete",
)
MENU = (
    "home", "menu", "login", "log in", "sign in", "sign up", "search", "next", "previous", "share", "contact", "contact us", "about", "about us", "read more", "back to top", "skip to content",
    "startseite", "menü", "anmelden", "suche", "weiter", "zurück", "teilen", "kontakt", "über uns", "mehr lesen", "nach oben",
    "accueil", "connexion", "recherche", "suivant", "précédent", "partager", "contactez-nous", "à propos", "lire la suite", "haut de page",
    "inicio", "menú", "iniciar sesión", "buscar", "siguiente", "anterior", "compartir", "contacto", "acerca de", "leer más",
)


def _lost(text: Column, pattern: str) -> Column:
    """Bytes of all matches of an ASCII pattern."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))).cast("long")


MARKS = ["has_sign", "has_bar", "has_brace", "has_phrase"]


def _whole_text_marks(text: Column) -> list[Column]:
    """Whether a text has anything that a rule looks for; lines of other texts aren't searched for it."""
    low = F.lower(text)
    phrase = F.contains(low, F.lit(BOILERPLATE[0]))
    for x in BOILERPLATE[1:]:
        phrase = phrase | F.contains(low, F.lit(x))
    return [text.rlike(r"[#*$%&|<>!?]").alias("has_sign"), text.rlike(r"[|»·›]").alias("has_bar"), text.rlike(r"[{}]").alias("has_brace"), phrase.alias("has_phrase")]


def _squeezed(line: Column) -> Column:
    return F.regexp_replace(line, WHITE, "")


def clean_lines(docs: DataFrame, sign_share: float = 0.08, nav_bars: int = 3, min_kept: float = 0.6, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """doc_id, the counts of the base rules, base_failed, lines_dropped, kept_chars, kept and cleaned.

    A null text has no line and no word: all counts are 0, base_failed is true. ``cleaned`` joins the lines
    that passed by a line feed and is empty for rejected documents. A very long text is read whole. Rows that repeat stay
    rows; a null doc_id stays null; columns other than doc_id and text are not read.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", t.alias("t"))
    df = df.select(
        "doc_id",
        F.array_remove(F.split("t", WHITE), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.regexp_replace(x, WHITE, "") != "").alias("lines"),
        _lost(F.col("t"), SIGNS).alias("n_symbols"),
        *_whole_text_marks(F.col("t")),
    )
    df = df.select("*", F.size("w").cast("long").alias("n_words"), F.array_distinct("lines").alias("distinct_lines"))
    # Three-word windows as (hash, position), sorted, so that equal windows are neighbours.
    grams = F.when(
        F.col("n_words") >= 3,
        F.sort_array(
            F.transform(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(1))).alias("b"), F.slice("w", 3, F.greatest(F.size("w") - 2, F.lit(1))).alias("c")), lambda g, i: F.struct(F.xxhash64(g["a"], g["b"], g["c"]).alias("h"), i.alias("i")))
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.select("doc_id", "n_symbols", "n_words", "lines", "distinct_lines", *MARKS, F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.filter(grams, lambda g: g["i"] < F.col("n_words") - 2).alias("g"))
    # A position is repeated if its hash equals a neighbour's.
    df = df.withColumn("d", F.arrays_zip(F.col("g").alias("x"), F.slice("g", 2, F.greatest(F.size("g"), F.lit(1))).alias("y"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.col("g")).alias("z")))
    df = df.withColumn("p", F.sort_array(F.transform(F.filter("d", lambda e: F.coalesce(e["x"]["h"] == e["y"]["h"], F.lit(False)) | F.coalesce(e["x"]["h"] == e["z"]["h"], F.lit(False))), lambda e: e["x"]["i"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    df = df.withColumn("n_repeat_words", F.aggregate("p", start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(i - s["last"], F.lit(3))).cast("long").alias("n")), lambda s: s["n"]))

    def good(line: Column) -> Column:
        low = F.lower(F.trim(line))
        bare = _squeezed(line)
        size = F.length(bare)
        signs = F.col("has_sign") & (size - F.length(F.regexp_replace(bare, r"[#*$%&|<>!?]+", "")) > size * F.lit(sign_share))
        bars = F.col("has_bar") & (F.length(line) - F.length(F.regexp_replace(line, r"[|»·›]+", "")) >= nav_bars)
        return ~(signs | (F.col("has_brace") & line.rlike(r"[{}]")) | bars | low.isin(*MENU) | (F.col("has_phrase") & low.rlike("|".join(BOILERPLATE))))

    df = df.withColumn("good", F.filter("distinct_lines", good))
    df = df.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size("distinct_lines")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))).alias("base_failed"),
        (F.size("lines") - F.size("good")).cast("long").alias("lines_dropped"),
        F.length(F.regexp_replace(F.array_join("good", ""), WHITE, "")).cast("long").alias("kept_chars"),
        F.array_join("good", "\n").alias("cleaned"),
    )
    kept = ~F.col("base_failed") & (F.col("kept_chars") >= F.col("word_chars") * F.lit(min_kept))
    df = df.withColumn("kept", kept).withColumn("cleaned", F.when(F.col("kept"), F.col("cleaned")).otherwise(""))
    # One generated row each: filters on the result aren't pushed below, where each would compute its columns anew.
    return df.select(F.inline(F.array(F.struct(*df.columns))))


BASE_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
