"""String functions over columns; all run on the JVM.

Python's ``\\w`` on Unicode text is ``[\\p{L}\\p{N}_]`` here, its white space ``[\\s\\p{Z}]``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}_\s\p{Z}]"
SPACE = r"[\s\p{Z}]+"

#: Words that are no academic concepts.
NON_ACADEMIC = (
    "university", "college", "school", "department", "center", "institute", "program", "studies", "research", "science",
    "sciences", "technology", "administration", "management", "development", "international", "public", "general", "applied",
    "theoretical", "advanced", "basic", "modern", "clinical", "experimental", "social", "human", "natural", "physical",
    "page", "home", "about", "contact", "staff", "faculty", "links", "click", "here", "website", "portal", "login", "apply",
    "apply now", "register", "registration", "more", "learn more", "read more", "back", "next", "previous", "link", "site",
    "menu", "navigation",
)
#: Terms that rule validation refuses.
BLACKLIST = (
    "test", "example", "sample", "demo", "none", "null", "undefined", "unknown", "other", "misc", "miscellaneous", "page",
    "home", "index", "about", "contact",
)
#: Irregular plurals.
LEMMAS = {
    "data": "data", "media": "media", "criteria": "criteria", "analyses": "analysis", "hypotheses": "hypothesis",
    "phenomena": "phenomenon", "curricula": "curriculum", "syllabi": "syllabus", "theses": "thesis", "indices": "index",
    "matrices": "matrix",
}
#: British and American spellings.
SPELLINGS = (
    ("behaviour", "behavior"), ("analyse", "analyze"), ("modelling", "modeling"), ("defence", "defense"), ("centre", "center"),
    ("programme", "program"), ("catalogue", "catalog"), ("colour", "color"), ("organisation", "organization"),
    ("specialisation", "specialization"), ("labour", "labor"),
)
#: Abbreviations and their long forms.
SYNONYMS = (
    ("ML", "machine learning"), ("AI", "artificial intelligence"), ("NLP", "natural language processing"),
    ("CV", "computer vision"), ("DL", "deep learning"),
)
#: Words that initials leave out.
INITIAL_STOPS = ("of", "and", "the", "for", "in", "on", "at")


def words(text: Column) -> Column:
    """The words between white space, without empty ones."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def normalise(text: Column) -> Column:
    """Lower case, dashes and underscores as spaces, no possessives or apostrophes, single spaces."""
    plain = F.translate(F.lower(F.trim(text)), "-_", "  ")
    plain = F.replace(F.replace(plain, F.lit("'s"), F.lit("")), F.lit("'"), F.lit(""))
    return F.array_join(words(plain), " ")


def clean(text: Column) -> Column:
    """Lower case, anything but words, white space and dashes as a space, single spaces."""
    return F.array_join(words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s\p{Z}-]", " ")), " ")


def lemma(word: Column) -> Column:
    """Singular of a word: irregular ones, then -ies, -es and -s."""
    table = F.create_map(*[F.lit(x) for pair in LEMMAS.items() for x in pair])
    n = F.length(word)
    return (
        F.when(F.lower(word).isin(*LEMMAS), F.element_at(table, F.lower(word)))
        .when(word.endswith("ies") & (n > 3), F.concat(F.left(word, n - 3), F.lit("y")))
        .when(word.endswith("es") & (n > 2), F.left(word, n - 2))
        .when(word.endswith("s") & (n > 1) & ~word.endswith("ss"), F.left(word, n - 1))
        .otherwise(word)
    )


def lemmatised(text: Column) -> Column:
    """Lower case, marks as spaces, each word's singular."""
    return F.array_join(F.transform(words(F.regexp_replace(F.lower(text), NOT_WORD, " ")), lemma), " ")


def plural(word: Column) -> Column:
    """Plural of a singular word: -y to -ies, -es after a hiss, else -s."""
    return (
        F.when(word.endswith("y"), F.concat(F.left(word, F.length(word) - 1), F.lit("ies")))
        .when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def plural_forms(term: Column) -> Column:
    """The term and the forms that differ in its last word's number, sorted."""
    parts = words(term)
    last = F.element_at(parts, -1)
    one = lemma(F.lower(last))
    forms = F.when(F.lower(last).isin(*LEMMAS), F.array(one)).otherwise(
        F.array(F.when(one != F.lower(last), one), F.when(one == F.lower(last), plural(last)))
    )
    head = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    rebuilt = F.transform(F.array_compact(forms), lambda w: F.array_join(F.concat(head, F.array(w)), " "))
    return F.when(F.size(parts) == 0, F.array(term)).otherwise(F.array_sort(F.array_union(F.array(term), rebuilt)))


def spelling_forms(term: Column) -> Column:
    """The term and its other spellings, sorted."""
    low = F.lower(term)
    found = [
        F.when(F.contains(low, F.lit(uk)), F.replace(low, F.lit(uk), F.lit(us))).when(F.contains(low, F.lit(us)), F.replace(low, F.lit(us), F.lit(uk)))
        for uk, us in SPELLINGS
    ]
    return F.array_sort(F.array_union(F.array(term), F.array_compact(F.array(*found))))


def dash_forms(term: Column) -> Column:
    """The term with dashes as spaces and spaces as dashes, sorted."""
    return F.array_sort(F.array_distinct(F.array(term, F.translate(term, "-", " "), F.translate(term, " ", "-"))))


def variations(term: Column) -> Column:
    """Closure of the term and its lemmatised form under plural, spelling and dash forms, in this order."""
    out = F.array_union(F.array(term), F.array(lemmatised(term)))
    for forms in (plural_forms, spelling_forms, dash_forms):
        out = F.array_union(out, F.flatten(F.transform(out, forms)))
    return F.array_sort(out)


def valid_concept(concept: Column, low: int = 2, high: int = 100) -> Column:
    """Length in bounds, no short run of digits or letters, not in the stop list, some letter or digit."""
    n = F.length(concept)
    return (
        n.between(low, high)
        & ~((n <= 2) & (concept.rlike(r"^\p{N}+$") | concept.rlike(r"^\p{L}+$")))
        & ~F.lower(concept).isin(*NON_ACADEMIC)
        & concept.rlike(r"[\p{L}\p{N}]")
    )


def initials(term: Column, skip: tuple[str, ...] = ()) -> Column:
    """Upper-case initials of the words, without those in ``skip``."""
    kept = F.filter(words(term), lambda w: ~F.lower(w).isin(*skip)) if skip else words(term)
    return F.upper(F.array_join(F.transform(kept, lambda w: F.left(w, F.lit(1))), ""))


def content_type(text: Column) -> Column:
    """Kind of a content by the first keyword pair that it has."""
    low = F.lower(text)
    has = lambda *keys: reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keys])
    return (
        F.when(has("conference", "proceedings"), "conference")
        .when(has("syllabus", "curriculum"), "course")
        .when(has("journal", "doi"), "journal")
        .when(has("lecture", "notes"), "lecture_notes")
        .otherwise("article")
    )


def occurrences(text: Column, key: str) -> Column:
    """How often ``key`` occurs in ``text``, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(key), F.lit("")))) / len(key)).cast("long")


def year(text: Column) -> Column:
    """First year from 1900 to 2099, else null."""
    return F.nullif(F.regexp_extract(text, r"(19|20)\d{2}", 0), F.lit(""))


def doi(text: Column) -> Column:
    """First digital object identifier, else null."""
    return F.nullif(F.regexp_extract(text, r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+", 0), F.lit(""))


def snake(name: Column) -> Column:
    """camelCase to snake_case."""
    return F.lower(F.regexp_replace(name, "(?<!^)(?=[A-Z])", "_"))


def first_upper(text: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.greatest(F.length(text), F.lit(1))))


def cache_key(term: Column, modes: tuple[str, ...]) -> Column:
    """SHA-256 of the lower-case term and the sorted modes."""
    return F.sha2(F.concat(F.lower(F.trim(term)), F.lit(":" + ",".join(sorted(modes)))), 256)


def clean_parent(parent: Column) -> Column:
    """Without quotes round it and marks in it, lower case, single spaces."""
    bare = F.trim(parent)
    quoted = (bare.startswith('"') & bare.endswith('"')) | (bare.startswith("'") & bare.endswith("'"))
    bare = F.when(quoted, F.substring(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0)))).otherwise(bare)
    return F.coalesce(F.array_join(words(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}_\s\p{Z}-]", "")), " "), F.lit(""))


#: Heads of an institution's name, in the order in which they are tried.
HEADS = ("department of", r"dept\.? of", "school of", "institute of", "institute for", "center for", "centre for", "division of", "program in", "programme in", "college of", "faculty of")


def concept_of_source(source: Column) -> Column:
    """The subject in a department's or college's name, else null."""
    low = F.lower(source)
    found = F.coalesce(*[F.nullif(F.regexp_extract(low, h + r" (.+?)(?:\s*[-–]\s*|$)", 1), F.lit("")) for h in HEADS])
    for tail in (r"\s*\([^)]*\)\s*$", r"\s*department\s*$", r"\s*school\s*$"):
        found = F.regexp_replace(found, tail, "")
    return F.when(found.isNotNull(), clean_parent(found))


def is_department(source: Column) -> Column:
    """Whether a source names a department or college."""
    low = F.lower(source)
    return F.coalesce(low.rlike("|".join(HEADS)) | low.rlike("(department|dept|school|institute|center|centre|division|program|programme)$"), F.lit(False))
