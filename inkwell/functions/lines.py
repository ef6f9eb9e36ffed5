"""What a line of a page looks like: captions, list items, contents, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, let, trim_space, words

#: Beginnings of captions; fixed values.
CAPTIONS = ["Figura ", "Fig. ", "Fig ", "Tabela ", "Source:", "Fonte:", "Source ", "Fonte ", "Note:", "Nota:", "Chart ", "Gráfico ", "Graph ", "Diagram ", "Image ", "Imagem ", "Photo ", "Foto "]
#: Parts of the names of fonts with equal widths; fixed values.
MONOSPACE = ["courier", "consolas", "monaco", "menlo", "mono", "fixed", "terminal", "typewriter", "source code", "fira code", "jetbrains", "inconsolata", "dejavu sans mono", "liberation mono"]
#: Beginnings of lines of code; fixed values.
CODE = ["import ", "export ", "from ", "const ", "let ", "var ", "function ", "class ", "def ", "pub fn ", "fn ", "async fn ", "impl ", "=> ", "-> ", ":: ", ":= "]
BULLETS = "•○●◦"


def _any_start(c: Column, starts: list[str]) -> Column:
    found = F.lit(False)
    for s in starts:
        found = found | c.startswith(s)
    return found


def is_caption(c: Column) -> Column:
    """A caption or a source line; figures and tables need a number after them."""
    t = trim_space(c)
    return _any_start(t, CAPTIONS) | F.lower(t).rlike(f"^(figure|table) {SPACE}*[0-9(#]") | F.lower(t).startswith("source:")


def starts_with_bullet(c: Column) -> Column:
    return c.rlike(f"^{SPACE}*[{BULLETS}*-] ")


def is_list_item(c: Column) -> Column:
    """A bullet, up to four digits with a point or bracket, a letter, or (x)."""
    t = F.regexp_replace(c, f"^{SPACE}+", "")
    digits = F.substring(t, 1, 5).rlike("[0-9]") & F.substring(t, 1, 5).rlike(r"^[0-9]*[.)]")
    return starts_with_bullet(c) | digits | t.rlike(r"^[A-Za-z][.)]") | t.rlike(r"^\((?s:.)\)")


def format_list_item(c: Column) -> Column:
    """The line with Markdown's bullet, taken out of emphasis that it opens."""
    t = F.regexp_replace(c, f"^{SPACE}+", "")
    return F.regexp_replace(t, f"^(\\*\\*|\\*|<u>)?[{BULLETS}]{SPACE}*", "- $1")


def has_dot_leaders(c: Column) -> Column:
    return c.contains("....") | (F.regexp_count(c, F.lit(r"\.{3,}")) >= 2)


def is_toc_entry(c: Column) -> Column:
    """Dots and then a page number at the end."""
    return trim_space(c).rlike(f"\\.{{3,}}{SPACE}*[0-9]{{1,4}}$")


def is_monospace(name: Column) -> Column:
    low, found = F.lower(name), F.lit(False)
    for part in MONOSPACE:
        found = found | low.contains(part)
    return found


def is_code_like(c: Column) -> Column:
    t = trim_space(c)
    special = F.length(t) - F.length(F.translate(t, "{}()[];=<>", ""))
    return _any_start(t, CODE) | ((special >= 3) & (F.octet_length(t) < 200)) | t.rlike("[;{}]$")


def numbering(c: Column) -> Column:
    """struct(kind, parts) of a line's first word (``1.2.``, ``IV)``), or null.

    Every part of a decimal has one to three digits; a roman numeral is one part.
    """
    first = F.get(words(c), 0)
    token = F.regexp_replace(first, r"[.):]+$", "")
    delimited = first.rlike(r"[.):]$") & (token != "")
    decimal = token.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3})*$")
    values = F.create_map(*[x for k, v in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}.items() for x in (F.lit(k), F.lit(v))])
    signs = F.filter(F.split(token, ""), lambda s: s != "")
    worth = F.transform(signs, lambda s: F.element_at(values, s))
    total = let(worth, lambda w: F.aggregate(F.transform(w, lambda v, i: F.when(F.get(w, i + 1) > v, -v).otherwise(v)), F.lit(0), lambda s, v: s + v))
    whole = F.transform(F.split(token, r"\."), lambda p: p.cast("int"))
    return (
        F.when(delimited & decimal, F.struct(F.lit("decimal").alias("kind"), whole.alias("parts")))
        .when(delimited & token.rlike("^[IVXLC]+$"), F.struct(F.lit("roman").alias("kind"), F.array(total).alias("parts")))
    )


def forms_hierarchy(a: Column, b: Column) -> Column:
    """Whether one array of parts begins with the other and is longer."""
    short, long = F.when(F.size(a) < F.size(b), a).otherwise(b), F.when(F.size(a) < F.size(b), b).otherwise(a)
    return (F.size(a) != F.size(b)) & (F.slice(long, F.lit(1), F.size(short)) == short)


def title_like(c: Column, numbered: Column, bold: Column) -> Column:
    """1 to 12 words and 4 to 140 characters that could be a heading."""
    t = trim_space(c)
    every = words(t)
    lettered = F.filter(every, lambda w: w.rlike(r"\p{L}"))
    capital = F.filter(every, lambda w: w.rlike(r"^\P{L}*\p{Lu}"))
    fit = F.size(every).between(1, 12) & F.length(t).between(4, 140) & t.rlike(r"\p{L}") & ~t.rlike("[.,;]$")
    plain = ~starts_with_bullet(t) & ~is_caption(t) & ~is_toc_entry(t)
    return fit & plain & (numbered | ~is_list_item(t)) & (numbered | bold | (F.size(capital) * 2 >= F.greatest(F.size(lettered), F.lit(1))))


def is_letter_spaced(c: Column) -> Column:
    """``l i k e  t h i s``: spaces at every second place."""
    return c.rlike(r"^\S( \S)+ ?$")


def heading_level(ratio: Column, bold: Column, tiers: Column, size: Column) -> Column:
    """Level of a line by its size over the body's, the document's tiers (largest
    first) and boldness; null for body text."""
    tier = F.array_position(F.transform(tiers, lambda t: F.abs(t - size) <= 0.5), F.lit(True))
    hit = F.when(tier > 0, tier.cast("int"))
    ladder = F.when(ratio >= 2.0, 1).when(ratio >= 1.5, 2).when(ratio >= 1.25, 3).otherwise(4)
    return (
        F.when(bold & (ratio >= 1.05) & (ratio < 1.2) & hit.isNotNull(), hit)
        .when(ratio < 1.2, None)
        .when(hit.isNotNull(), hit)
        .when(F.size(tiers) == 0, ladder)
        .when(ratio >= 1.5, F.least(F.size(tiers) + 1, F.lit(4)))
    )
