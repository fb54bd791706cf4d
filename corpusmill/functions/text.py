"""Text columns: white space, titles, tokens, names, identifiers, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section titles that hold no content of their own.
BOILERPLATE = [
    "references", "reference list", "list of references", "bibliography", "works cited", "citations",
    "acknowledgements", "acknowledgments", "acknowledgement", "acknowledgment", "thanks", "thank you",
]
# What precedes a DOI, and an archive identifier as one.
DOI_PREFIX, ARCHIVE_DOI = "https://www.doi.org/", "10.48550/arXiv."
TOKEN = r"(?U)\w+|[^\w\s]"


#: What counts as white space: the characters of that property in Unicode.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends; SQL's trim without a set knows blanks only."""
    return F.trim(x, F.lit(SPACE))


def collapse(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def snippet(x: Column, size: int = 160) -> Column:
    return F.substring(collapse(x), 1, size)


def normal_title(x: Column) -> Column:
    """Lower case, `&` as `and`, anything but letters, digits and underscores as one blank."""
    words = F.regexp_replace(F.replace(F.lower(x), F.lit("&"), F.lit("and")), r"(?U)[^\w\s]", " ")
    return collapse(words)


def is_boilerplate(title: Column) -> Column:
    """A normal title that is one of BOILERPLATE, or one of them and more words."""
    return title.rlike(f"^({'|'.join(BOILERPLATE)})( |$)")


def tokens(x: Column) -> Column:
    """Words and single signs, in order."""
    return F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))


def token_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(TOKEN))


def terms(x: Column) -> Column:
    """Lower-case words, in order: no stems, no stop words."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)[\w]+"), F.lit(0))


def _name(parts: Column) -> Column:
    part = lambda i: F.nullif(F.trim(F.try_element_at(parts, F.lit(i))), F.lit(""))
    middle = F.regexp_replace(part(2), r"\s*-\s*", "-")
    joined = F.concat_ws(" ", part(1), middle, part(3))
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


def author_names(authors: Column) -> Column:
    """Usable names of three-part entries, in their order; hyphens of the second part lose the blanks beside them."""
    return F.filter(F.transform(authors, _name), lambda n: n != "")


def authors_line(authors: Column) -> Column:
    """All usable names with commas; null without any."""
    return F.nullif(F.array_join(author_names(authors), ", "), F.lit(""))


def canonical_id(x: Column) -> Column:
    """An identifier without path and `.html`; the old style gets its slash back."""
    bare = F.regexp_replace(F.regexp_replace(x, r"^.*/", ""), r"\.html$", "")
    old = bare.rlike(r"^.+[0-9]{7}(v[0-9]+)?$") & ~bare.rlike(r"^[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$")
    return F.when(old, F.regexp_replace(bare, r"^(.+?)([0-9]{7}(v[0-9]+)?)$", "$1/$2")).otherwise(bare)


def doi_url(doi: Column, id_: Column) -> Column:
    known = F.nullif(F.trim(doi), F.lit(""))
    return F.concat(F.lit(DOI_PREFIX), F.coalesce(known, F.concat(F.lit(ARCHIVE_DOI), id_)))


def timestamp(x: Column) -> Column:
    """ISO or mail dates; the weekday of the latter is not needed."""
    plain = F.regexp_replace(x, "^[A-Za-z]{3}, ", "")
    return F.coalesce(F.try_to_timestamp(plain), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss z")))


def citation(title: Column, journal: Column, url: Column) -> Column:
    """`[title. journal](url)`; line ends become blanks, missing or empty parts are left out."""
    part = lambda x: F.nullif(F.replace(x, F.lit("\n"), F.lit(" ")), F.lit(""))
    label = F.concat_ws(". ", part(title), part(journal))
    return F.concat(F.lit("["), label, F.lit("]("), F.coalesce(url, F.lit("")), F.lit(")"))


def node_id(*parts: Column) -> Column:
    """The same id for the same place in the same document, on every run."""
    return F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256)
