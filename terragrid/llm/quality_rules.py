"""Line-first quality rules, with DataFrame functions only.

Every line with a word is judged by three kinds of rule: punctuation (over a
fifth of its characters other than white space are symbols, over a third of its
words end in runs of exclamation or question marks, or it has ``SENTENCE`` words
or more and no sentence ends in it), navigation (a separator for every three
words, or a menu word alone) and boilerplate (stock phrases of notices), both in
English, German, French and Spanish.  Failing lines are removed; a document that
loses more than ``max_lost`` of its words is rejected, and so is one that fails
the base rules (under ``min_words`` words, or over ``max_repeat`` percent of its
words in 8-word windows that it has twice).

Nulls: a null text has no words and is rejected by the base rules.  All rows
are kept in ``measure``; rows with equal texts get equal verdicts.  An empty
table gives an empty result.  Columns of the input named like an output are
replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import free_name, let

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»•"
#: words from which a line must have the end of a sentence
SENTENCE = 5
ENDS = r"[.!?…。！？][\"'”’»)\]]*(?:[\x20\x09-\x0D]|$)"
#: menu words, of a line alone
MENU = (
    ("home", "menu", "search", "login", "log in", "log out", "sign in", "sign up", "register", "next", "previous", "back", "back to top", "share", "print", "contact", "contact us", "about", "about us", "sitemap", "read more", "skip to content", "skip to main content"),
    ("startseite", "menü", "suche", "anmelden", "abmelden", "registrieren", "weiter", "zurück", "nach oben", "teilen", "drucken", "kontakt", "über uns", "impressum", "datenschutz", "mehr lesen", "weiterlesen", "zum inhalt springen"),
    ("accueil", "rechercher", "recherche", "connexion", "se connecter", "déconnexion", "s'inscrire", "suivant", "précédent", "retour", "haut de page", "partager", "imprimer", "nous contacter", "à propos", "plan du site", "lire la suite", "aller au contenu"),
    ("inicio", "menú", "buscar", "iniciar sesión", "cerrar sesión", "registrarse", "siguiente", "anterior", "volver", "volver arriba", "compartir", "imprimir", "contacto", "acerca de", "mapa del sitio", "leer más", "saltar al contenido"),
)
#: phrases of notices; \\w* stands for endings
NOTICES = (
    (r"all rights reserved", r"terms of (?:use|service)", r"privacy policy", r"cookie policy", r"(?:uses?|accept|enable) cookies", r"(?:enable|requires) javascript", r"javascript is (?:disabled|required)", r"subscribe to our newsletter", r"follow us on", r"click here to", r"powered by", r"page not found", r"advertisement"),
    (r"alle rechte vorbehalten", r"allgemeine geschäftsbedingungen", r"nutzungsbedingungen", r"datenschutzerklärung", r"(?:verwendet|akzeptieren|aktivieren) (?:sie )?cookies", r"javascript (?:ist deaktiviert|aktivieren)", r"newsletter abonnieren", r"folgen sie uns", r"klicken sie hier", r"seite nicht gefunden", r"anzeige"),
    (r"tous droits réservés", r"conditions (?:générales|d'utilisation)", r"politique de confidentialité", r"(?:utilise|accepter|activer) (?:des |les )?cookies", r"(?:activer|activez) javascript", r"abonnez-vous à", r"suivez-nous", r"cliquez ici", r"page introuvable", r"publicité"),
    (r"todos los derechos reservados", r"(?:términos|condiciones) de uso", r"política de (?:privacidad|cookies)", r"(?:usa|utiliza|aceptar) cookies", r"(?:activar|habilite) javascript", r"suscríb\w+ a nuestr\w+", r"síguenos en", r"haga clic aquí", r"página no encontrada", r"publicidad"),
)
NAVIGATION = r"^[^\p{L}\p{N}]*(?:" + "|".join(w for words in MENU for w in words) + r")[^\p{L}\p{N}]*$"
def _any_phrase(phrases: list[str]) -> str:
    """Phrases as whole words, by their first letters, so that few are tried at a place."""
    by: dict[str, list[str]] = {}
    for p in phrases:
        by.setdefault(p[0] if p[0] != "(" else "", []).append(p[1:] if p[0] != "(" else p)
    first = "".join(sorted({*filter(None, by), *(x[0] for p in by.get("", []) for x in re.findall(r"^\(\?:([^)]*)\)", p)[0].split("|"))}))
    inner = "|".join(f"{c}(?:{'|'.join(ps)})" for c, ps in by.items())
    return rf"(?=[{first}])(?<![\p{{L}}\p{{N}}])(?:{inner})(?![\p{{L}}\p{{N}}])"


BOILERPLATE = _any_phrase([p for phrases in NOTICES for p in phrases])
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "n_lost_words", "base_failed", "kept", "clean_text")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text."""

    def covered(hashes):
        # places sorted by hash; a window is repeated if a neighbour has its hash
        def places(order):
            inner = lambda x, i: ((i > 0) & (F.get(order, i - 1)["h"] == x["h"])) | ((i < F.size(order) - 1) & (F.get(order, i + 1)["h"] == x["h"]))
            return let(F.array_sort(F.transform(F.filter(order, inner), lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x))

        several = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(several, let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), places)).otherwise(0)

    def counted(w):
        return F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(
            let(F.transform(w, lambda x: F.xxhash64(x)), lambda v: let(F.transform(F.sequence(F.lit(0), F.size(v) - WINDOW), lambda i: F.xxhash64(*(F.get(v, i + j) for j in range(WINDOW)))), covered))
        )

    return let(words, counted).cast("long")


def _count(text: Column, chars: str) -> Column:
    """How many of ``chars`` the text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _traits(text: Column) -> Column:
    """What some line of the text may have: rules on anything else needn't be asked."""
    return F.struct(text.rlike(f"[{SYMBOLS}]").alias("symbols"), text.rlike(f"[{SEPARATORS}]").alias("separators"), text.rlike(r"[!?]{2}").alias("shouts"), F.lower(text).rlike(BOILERPLATE).alias("notices"))


def bad_line(line: Column, words: Column, traits: Column) -> Column:
    """Whether a line of so many words, one at least, of a text with such traits fails a rule."""
    symbols = traits["symbols"] & (_count(line, SYMBOLS) * 5 > F.length(F.translate(line, BLANKS, "")))
    shouts = traits["shouts"] & (words >= 3) & (_count(line, "!?") * 3 > words * 2) & (F.regexp_count(line, F.lit(r"[!?]{2,}")) * 3 > words)
    menu = traits["separators"] & (_count(line, SEPARATORS) * 3 >= words)
    endless = (words >= SENTENCE) & ~line.rlike(ENDS)
    return symbols | menu | shouts | endless | ((words < 8) & F.lower(line).rlike(NAVIGATION)) | (traits["notices"] & F.lower(line).rlike(BOILERPLATE))


def measure(docs: DataFrame, text_col: str = "text", min_words: int = 20, max_repeat: int = 30, max_lost: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with the counts, the verdict and the text without its failing lines."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def facts(t):
        # each line once: its words, and whether it fails
        judged = let(_traits(t), lambda traits: F.transform(F.split(t, "\n", -1), lambda x: let(F.size(_words(x)), lambda n: F.struct(x.alias("x"), n.alias("n"), ((n > 0) & bad_line(x, n, traits)).alias("bad")))))

        def of_lines(lines):
            bad = F.filter(lines, lambda z: z["bad"])
            full = F.filter(lines, lambda z: z["n"] > 0)
            return F.struct(
                (F.size(full) - F.size(F.array_distinct(F.transform(full, lambda z: z["x"])))).cast("long").alias("dup"),
                F.size(bad).cast("long").alias("lines"),
                F.aggregate(bad, F.lit(0), lambda s, z: s + z["n"]).cast("long").alias("words"),
                F.array_join(F.transform(F.filter(lines, lambda z: ~z["bad"]), lambda z: z["x"]), "\n").alias("clean"),
            )

        return let(_words(t), lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.length(F.translate(t, BLANKS, "")).cast("long").alias("chars"),
            F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("symbols"),
            _repeat_words(w).alias("repeat"),
            let(judged, of_lines).alias("l"),
        ))

    name = free_name(docs, "__facts")
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    out = docs.withColumn(name, let(text, facts)).drop(*(c for c in docs.columns if c in OUTPUTS))
    g = lambda c: F.col(f"{name}.{c}")
    out = out.withColumns({"n_words": g("n"), "word_chars": g("chars"), "n_symbols": g("symbols"), "n_dup_lines": g("l.dup"), "n_repeat_words": g("repeat"), "n_bad_lines": g("l.lines"), "n_lost_words": g("l.words"), "clean_text": g("l.clean")})
    return out.drop(name).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= F.col("n_words") * max_lost))


def keep_good(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return measure(docs.select(row, F.col(text_col).alias("t")), "t", **rules).where("kept").select("row.*")
