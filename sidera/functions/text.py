"""Text functions, Column to Column; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it, beyond what trim() takes.
SPACE = r"(?U)\s+"
EDGES = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, SPACE, " "))


def as_text(c: Column) -> Column:
    """The value as text, null as ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def ensure_text(c: Column) -> Column:
    return strip(as_text(c))


def na_to_null(c: Column) -> Column:
    """null, blank and the literal NA as null."""
    return F.when(c.isNull() | (strip(c) == "") | (c == "NA"), F.lit(None)).otherwise(c)


def list_to_csv(c: Column) -> Column:
    return F.when(c.isNull(), "N/A").otherwise(F.array_join(c, ", "))


def words(c: Column) -> Column:
    """Parts between single spaces; empty and trailing parts count."""
    return F.split(c, " ", -1)


def prefix_words(c: Column, n: int = 6) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def middle_words(c: Column, n: int = 4) -> Column:
    w = words(c)
    begin = F.greatest(F.floor(F.size(w) / 2).cast("int") - 2, F.lit(0)) + 1
    return F.array_join(F.slice(w, begin, F.lit(n)), " ")


def snippets(c: Column, offsets: tuple[int, ...] = (50, 100, 200), length: int = 50) -> Column:
    """The parts of `length` characters at the offsets that leave 10 more and aren't nearly blank."""
    made = F.transform(F.array(*map(F.lit, offsets)), lambda i: F.when(F.length(c) >= i + length + 10, F.substring(c, i + 1, F.lit(length))))
    return F.filter(made, lambda s: s.isNotNull() & (F.length(strip(s)) >= 10))


def second_level(c: Column, sep: str = " > ") -> Column:
    """The second part of a category path, else the first."""
    parts = F.split(c, sep, -1)
    return F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))


def category_path(c: Column) -> Column:
    return F.filter(F.transform(F.split(as_text(c), ">", -1), strip), lambda p: p != "")


def category_depth(gold: Column, pred: Column) -> Column:
    """How many levels two category paths share from the root, case aside."""
    g, p = category_path(gold), category_path(pred)
    same = F.zip_with(g, p, lambda a, b: F.lower(a) == F.lower(b))
    first = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    return F.when(first > 0, first.cast("int") - 1).otherwise(F.size(same))


def category_match(gold: Column, pred: Column, level: int) -> Column:
    return (F.size(category_path(gold)) >= level) & (F.size(category_path(pred)) >= level) & (category_depth(gold, pred) >= level)


def tokens(c: Column) -> Column:
    """Lower-case tokens with closing signs apart."""
    t = F.regexp_replace(strip(F.lower(c)), r'["()\[\]{}<>]', " ")
    t = F.regexp_replace(t, r"(?U)([.,!?;:])\s", " $1 ")
    return F.filter(F.split(F.regexp_replace(t, SPACE, " "), " ", -1), lambda x: x != "")


def alnum_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def strip_fence(c: Column) -> Column:
    """A fenced block without its fences: the first line goes if it opens one, and a closing one at the end."""
    body = F.regexp_replace(strip(c), r"^```[^\n]*\n?", "")
    return F.when(strip(c).startswith("```"), strip(F.regexp_replace(body, r"```\s*$", ""))).otherwise(strip(c))


def strip_special(c: Column, marks: tuple[str, ...] = ("<|im_end|>", "<|im_start|>", "<|endoftext|>")) -> Column:
    for m in marks:
        c = F.replace(c, F.lit(m), F.lit(""))
    return strip(c)


_SPECIES = {"other": "ant frog hermit_crab pig chicken goat poultry insect all", "small_animal": "rabbit ferret", "reptile": "turtle"}
_SPECIES_KEPT = "dog cat fish bird small_animal reptile horse other"
_STAGES = {"puppy": "baby newborn foal young growing juvenile juveniles small kitten,puppy puppy,kitten", "senior": "adult,senior senior,all", "all": "puppy,kitten,adult,senior"}
_STAGES_KEPT = "puppy kitten adult senior all"


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for to, names in table.items() for n in names.split() for x in (n, to)))


def species(c: Column) -> Column:
    """The species in the closed list: the first of several, mapped; unknown ones are 'other'."""
    first = F.when(c.contains(","), strip(F.split_part(c, F.lit(","), F.lit(1)))).otherwise(c)
    mapped = F.coalesce(F.try_element_at(_lookup(_SPECIES), first), first)
    return F.when(c.isNull(), F.lit(None)).when(mapped.isin(_SPECIES_KEPT.split()), mapped).otherwise("other")


def life_stage(c: Column) -> Column:
    """The stage in the closed list: a list of stages is looked up whole before its first; unknown ones are null."""
    table = _lookup(_STAGES)
    one = F.when(c.contains(","), F.coalesce(F.try_element_at(table, c), strip(F.split_part(c, F.lit(","), F.lit(1))))).otherwise(c)
    mapped = F.coalesce(F.try_element_at(table, one), one)
    return F.when(mapped.isin(_STAGES_KEPT.split()), mapped)


#: Keywords in order; the first that a text contains, inside a word or not, gives its intent.
INTENTS = (
    ("dog", "dog dogs puppy puppies canine"),
    ("cat", "cat cats kitten kittens feline"),
    ("fish", "fish aquarium tank marine"),
    ("bird", "bird birds parrot parakeet"),
    ("small_animal", "hamster rabbit guinea_pig rat mouse gerbil"),
    ("reptile", "reptile snake lizard turtle"),
)


def keyword_pairs(intents: tuple[tuple[str, str], ...] = INTENTS) -> list[tuple[str, str]]:
    return [(w.replace("_", " "), to) for to, ws in intents for w in ws.split()]


def intent(c: Column, intents: tuple[tuple[str, str], ...] = INTENTS) -> Column:
    low = F.lower(c)
    out = F.lit(None).cast("string")
    for w, to in reversed(keyword_pairs(intents)):
        out = F.when(low.contains(w), to).otherwise(out)
    return out


def labelled(parts: list[tuple[str, Column]]) -> Column:
    """'Label: value' lines of the parts that aren't empty."""
    return F.concat_ws("\n", *(F.when(ensure_text(c) != "", F.concat(F.lit(f"{name}: "), ensure_text(c))) for name, c in parts))


def first_existing(df: DataFrame, names: list[str], *, required: bool = True):
    found = next((n for n in names if n in df.columns), None)
    if found is None and required:
        raise ValueError(f"no column of {names}")
    return found
