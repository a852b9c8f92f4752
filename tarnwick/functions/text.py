"""Column functions on text: tokens, cleaning, identifiers, references, markup. All run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions import vocab as V


def tokenize(c: Column) -> Column:
    """Lower-cased runs of two or more ASCII letters and digits, with CamelCase parts separated."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([A-Z][a-z]+)", " $1"), "([A-Z]+)([A-Z][a-z])", " $1 $2")
    return F.regexp_extract_all(F.lower(spaced), F.lit("[a-zA-Z0-9]{2,}"), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end (Unicode white space, not blanks alone)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def clean_text(c: Column) -> Column:
    """Typographic characters made plain; footers, page numbers, contents and change-history lines removed; blanks collapsed."""
    c = F.translate(c, *V.CHARACTERS)
    for old, new in V.LIGATURES:
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(c, "(?i)" + V.FOOTER, "")
    for pattern in (V.PAGE_NUMBER, V.CONTENTS_LINE, V.CHANGE_LINE):
        c = F.regexp_replace(c, "(?md)" + pattern, "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def is_noise(c: Column, min_chars: int = 150, min_alpha: float = 0.25) -> Column:
    """Too short, or too few letters, measured against the stripped length."""
    size = F.length(strip(c))
    return (size < min_chars) | (F.length(F.regexp_replace(c, r"[^\p{L}]", "")) < size * min_alpha)


def preview(c: Column, n: int, more: str = "") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(more))).otherwise(c) if more else F.left(c, F.lit(n))


def detect_spec_id(name: Column, registry: dict[str, str] | None = None) -> Column:
    """'TS aa.bbb' from the first five digits of a file name, by registry if it has them; else '3GPP'."""
    code = F.regexp_extract(name, r"(\d{5})", 1)
    made = F.concat(F.lit("TS "), F.left(code, F.lit(2)), F.lit("."), F.substring(code, 3, 3))
    if registry:
        known = F.create_map(*(F.lit(x) for kv in registry.items() for x in kv))
        made = F.coalesce(F.element_at(known, code), made)
    return F.when(code == "", "3GPP").otherwise(made)


def stem(name: Column) -> Column:
    """File name without folders and last suffix."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def parse_spec_filename(name: Column) -> Column:
    """struct<spec_number, release, version>: the versioned form, else two digits and three, else the stem."""
    low = F.translate(F.lower(name), "-", "_")
    full = r"^ts[_\s]?1(\d{2})(\d{3})v(\d{2})(\d{2})(\d{2})"
    part = r"(\d{2})[\._](\d{3})"
    got = [F.regexp_extract(low, full, k) for k in range(1, 6)]
    number = [g.cast("int").cast("string") for g in got[2:]]
    two = [F.regexp_extract(low, part, k) for k in (1, 2)]
    return (
        F.when(got[0] != "", F.struct(F.concat(F.lit("TS "), got[0], F.lit("."), got[1]).alias("spec_number"), number[0].alias("release"), F.concat_ws(".", *number).alias("version")))
        .when(two[0] != "", F.struct(F.concat(F.lit("TS "), two[0], F.lit("."), two[1]).alias("spec_number"), F.lit("unknown").alias("release"), F.lit("unknown").alias("version")))
        .otherwise(F.struct(stem(name).alias("spec_number"), F.lit("unknown").alias("release"), F.lit("unknown").alias("version")))
    )


def query_entities(q: Column) -> Column:
    """struct<camel, objects, sections> of arrays, in order of appearance."""
    return F.struct(
        F.regexp_extract_all(q, F.lit(V.CAMEL_QUERY), F.lit(0)).alias("camel"),
        F.regexp_extract_all(q, F.lit(V.OBJECT_QUERY), F.lit(1)).alias("objects"),
        F.regexp_extract_all(q, F.lit(V.SECTION_QUERY), F.lit(1)).alias("sections"),
    )


def mo_path(description: Column) -> Column:
    """'Object.Parameter' of the first such reference, or null."""
    a, b = (F.regexp_extract(description, V.OBJECT_PATH, k) for k in (1, 2))
    return F.when(a != "", F.concat_ws(".", a, b))


def mo_class(path: Column) -> Column:
    return F.when(path.contains("."), F.split_part(path, F.lit("."), F.lit(1)))


def clean_cell(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "\n", " "), "\r", "")


def parameter_metadata(text: Column, normalised: Column) -> Column:
    """struct<parameter_name, mo_path, switch_name, counter_name>: rules in order of trust, the first that gives a field wins.

    normalised: the text after switch-name joining.
    """
    none = lambda c: F.when(c != "", c)
    switch, obj, par = (none(F.regexp_extract(normalised, V.SWITCH_SENTENCE, k)) for k in (1, 2, 3))
    counter = none(F.regexp_extract(text, V.COUNTER, 1))
    parts = F.split(counter, r"\.")
    by_counter = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 2, 1000), "."))
    inline = F.regexp_extract_all(normalised, F.lit(V.OBJECT_PARAMETER), F.lit(0))
    known = F.array(*map(F.lit, V.KNOWN_OBJECTS))
    hit = F.get(F.filter(inline, lambda m: F.array_contains(known, F.split_part(m, F.lit("."), F.lit(1)))), F.lit(0))
    hit = F.when(obj.isNull(), hit)
    camel = F.filter(F.regexp_extract_all(text, F.lit(V.CAMEL_PARAMETER), F.lit(1)), lambda m: (F.length(m) >= 8) & ~m.isin(V.NOT_PARAMETERS))
    return F.struct(
        F.coalesce(par, by_counter, F.split_part(hit, F.lit("."), F.lit(2)), F.get(camel, F.lit(0)), F.lit("")).alias("parameter_name"),
        F.coalesce(obj, F.split_part(hit, F.lit("."), F.lit(1)), F.lit("")).alias("mo_path"),
        F.coalesce(switch, F.lit("")).alias("switch_name"),
        F.coalesce(counter, F.lit("")).alias("counter_name"),
    )


def labelled_text(fields: dict[str, Column], source: Column) -> Column:
    """A record as lines 'Label: value'; empty fields leave no line, and the unit follows default and range."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    value = {k: F.trim(F.coalesce(c, F.lit(""))) for k, c in fields.items()}
    unit = F.when(has(fields["unit"]), F.concat(F.lit(" "), value["unit"])).otherwise("")
    line = lambda label, k, tail=F.lit(""): F.when(has(fields[k]), F.concat(F.lit(label + ": "), value[k], tail))
    return F.concat_ws(
        "\n",
        line("Parameter", "parameter_name"),
        line("MO Path", "mo_path"),
        line("Default Value", "default_value", unit),
        line("Value Range", "value_range", unit),
        line("Description", "description"),
        line("Section", "section"),
        F.concat(F.lit("Source: "), source),
    )


def md_to_html(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\*\*(.*?)\*\*", "<strong>$1</strong>")
    return F.regexp_replace(c, "`([^`]+)`", "<code>$1</code>")


def html_escape(c: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda made, p: F.replace(made, F.lit(p[0]), F.lit(p[1])), pairs, c)


def url_normal(c: Column) -> Column:
    return F.lower(F.trim(c))


def url_hash(c: Column) -> Column:
    return F.sha2(url_normal(c), 256)


def url_host(c: Column) -> Column:
    return F.split_part(F.regexp_replace(c, r"^https?://(www\.)?", ""), F.lit("/"), F.lit(1))


def chunk_id_v1(name: Column, index: Column) -> Column:
    return F.concat(name, F.lit("_chunk_"), F.lpad(index.cast("string"), 6, "0"))


def chunk_id_v2(name: Column, index: Column, text: Column, prefix: str = "3gpp") -> Column:
    safe = F.regexp_replace(name, "[^a-zA-Z0-9]", "_")
    return F.concat_ws("_", F.lit(prefix), safe, F.lpad(index.cast("string"), 5, "0"), F.left(F.md5(text.cast("binary")), F.lit(10)))


def allowed_references(text: Column) -> Column:
    """Clause numbers and 'TS a.b' references of a text, distinct and sorted."""
    numbers = F.regexp_extract_all(text, F.lit(V.CLAUSE_REF), F.lit(1))
    specs = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + V.SPEC_REF), F.lit(1)), lambda x: F.concat(F.lit("TS "), x))
    return F.array_sort(F.array_distinct(F.concat(numbers, specs)))


def clause_numbers(text: Column) -> Column:
    """Numbers of '§ a.b.c' references of three levels or more, without sign and blanks."""
    return F.transform(F.regexp_extract_all(text, F.lit(V.CLAUSE_REF_3), F.lit(0)), lambda x: F.regexp_replace(x, "[§ ]", ""))


def _replace_parts(text: Column, pattern: str, judge) -> Column:
    """Each match of `pattern` in `text` becomes judge(match); what is between matches stays."""
    rest = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    made = F.transform(found, judge)
    return F.array_join(F.transform(rest, lambda x, k: F.concat(x, F.coalesce(F.get(made, k), F.lit("")))), "")


def validate_citations_v2(answer: Column, allowed: Column) -> Column:
    """'§a.b.c' whose number is not in `allowed` becomes '[§ref]'; references of two levels stay."""
    return _replace_parts(answer, V.CLAUSE_REF_3, lambda m: F.when(F.array_contains(allowed, F.regexp_replace(m, "[§ ]", "")), m).otherwise("[§ref]"))


def validate_citations_v1(answer: Column, allowed: Column) -> Column:
    """Placeholders, and 'TS a.b §c' that neither holds nor is held by an allowed reference, are marked."""
    answer = F.regexp_replace(answer, V.PLACEHOLDER_REF, "[section not in retrieved docs]")
    bare = lambda c: F.regexp_replace(F.upper(c), r"\s+", "")

    def judge(m):
        ok = F.exists(allowed, lambda a: bare(m).contains(bare(a)) | bare(a).contains(bare(m)))
        return F.when(ok, F.trim(m)).otherwise(F.concat(F.lit("["), F.trim(m), F.lit(" — not in retrieved docs]")))

    return _replace_parts(answer, "(?i)" + V.SPEC_REF_FULL, judge)
