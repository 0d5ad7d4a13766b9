"""Column expressions on text. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"(\p{L}+)"

# Accented lower-case letters and the plain letter each one folds to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿß"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyys"


def words(text: str | Column) -> Column:
    """Lower-case letter runs of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def fold(label: str | Column) -> Column:
    """A label without case and accents, so that spelling variants meet."""
    return F.translate(F.lower(label), FOLD_FROM, FOLD_TO)


def ahead(toks: str | Column, k: int) -> Column:
    """The token list moved left by `k`, to line token i up with token i + k."""
    return F.slice(toks, k + 1, F.size(toks))
