"""Text functions as columns; patterns keep Unicode semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without white space of Unicode, and U+001C to U+001F, at both ends."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def collapse(x: Column) -> Column:
    return F.regexp_replace(strip(x), r"(?U)\s+", " ")


def normalise_winner(x: Column) -> Column:
    """response_a or response_b, null if neither; a text with both names is A."""
    v = collapse(F.regexp_replace(F.lower(x), "[-_]", " "))
    a = v.isin("a", "response a", "model a", "assistant a") | v.contains("response a") | v.endswith(": a")
    b = v.isin("b", "response b", "model b", "assistant b") | v.contains("response b") | v.endswith(": b")
    return F.when(v.isin("a", "response a", "model a", "assistant a"), "response_a").when(v.isin("b", "response b", "model b", "assistant b"), "response_b").when(a, "response_a").when(b, "response_b")


def parse_label(x: Column) -> Column:
    v = strip(x)
    return F.when(v.isin("Response A", "Response B"), v)


def truthy(*links: Column) -> Column:
    """The first link that isn't null or empty; the last even if empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in links[:-1]], links[-1])


def normalise_domain(x: Column) -> Column:
    v = F.lower(strip(x))
    out = F
    for d in ("chat", "code", "math", "safety"):
        out = out.when(v.startswith(d), d)
    return out


def difficulty_by_violations(n: Column) -> Column:
    return F.when(n == 1, "hard").when(n == 2, "normal").when(n >= 3, "simple")


def difficulty_by_styles(chosen: Column, rejected: Column) -> Column:
    return F.when(chosen < rejected, "hard").when(chosen == rejected, "normal").otherwise("easy")


def normalise_status(x: Column) -> Column:
    v = F.lower(collapse(x))
    return F.when(v == "met", "met").when(v == "not met", "not_met").when(v.isin("partially met", "not fully met"), "partial")


# The forms of a verdict, of its section, and of a name in it.
VERDICT = r"(?imU)(?:\*\*)?Final\s+Judg(?:e)?ment(?:\*\*)?\s*:\s*(?:\*\*)?(?:Response\s+)?([A-Z])\b"
VERDICT_SECTION = r"(?isU)(?:---\s*|\*\*)Final\s+Judg(?:e)?ment(?:\s*---|\*\*)?\s*:?(.*)\z"


def final_judgment(x: Column) -> Column:
    """The letter of the last explicit judgment; without any, the response that
    the final section names first."""
    stated = F.try_element_at(F.regexp_extract_all(x, F.lit(VERDICT), F.lit(1)), F.lit(-1))
    section = F.try_element_at(F.regexp_extract_all(x, F.lit(VERDICT_SECTION), F.lit(1)), F.lit(-1))
    named = F.try_element_at(F.regexp_extract_all(section, F.lit(r"(?iU)\bResponse\s+([AB])\b"), F.lit(1)), F.lit(1))
    return F.upper(F.coalesce(stated, named))


def normalise_judgment(x: Column) -> Column:
    """A or B at the end of a stored label."""
    return F.upper(F.try_element_at(F.regexp_extract_all(strip(x), F.lit(r"(?iU)(?:Response\s+)?([AB])\s*\z"), F.lit(1)), F.lit(1)))


def external_label(x: Column) -> Column:
    v = strip(x)
    return F.when(v.isin("Response A", "response_a"), "Response A").when(v.isin("Response B", "response_b"), "Response B")


def masked(x: Column, pattern: str) -> Column:
    """All that a pattern matches as blanks, lengths and line ends unchanged."""
    found, between = F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.split(x, F.lit(pattern), -1)
    blank = lambda m: F.regexp_replace(m, r"[^\n]", " ")
    return F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(blank(F.get(found, i)), F.lit("")))), "")


def without_lines(x: Column, head: str) -> Column:
    return strip(F.regexp_replace(x, rf"(?m)(?d)^{head}[^\n]*$\n?", ""))


def render_rubric(constraints: Column) -> Column:
    line = lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), F.rtrim(c, F.lit(".")))
    return F.array_join(F.transform(constraints, line), "\n")


def judge_prompt(preamble: str, *blocks: tuple[str, Column]) -> Column:
    return F.concat(F.lit(preamble), *[F.concat(F.lit(f"\n\n### {name}:\n"), text) for name, text in blocks])


# The reporting groups of the second reward benchmark.
SECOND_GROUPS = ("Factuality", "Precise IF", "Math", "Safety", "Focus", "Ties")


def reporting_group(subset: Column, domain: Column, difficulty: Column, sections: dict[str, list[str]]) -> Column:
    """The group that a subset's scores are reported under; a subset that no
    rule knows is its own, and a blank one is ``unknown``."""
    raw = truthy(subset, F.lit("unknown"))
    out = F
    for section, members in sections.items():
        out = out.when(raw.isin(*members), section)
    out = out.when(raw.isin(*SECOND_GROUPS), raw)
    rest = lambda prefix: F.lower(truthy(domain, F.substring(raw, len(prefix) + 1, 1 << 20)))
    out = out.when(raw.startswith("rm-bench-"), F.initcap(rest("rm-bench-")))
    out = out.when(raw.startswith("helpsteer3-"), F.when(rest("helpsteer3-") == "stem", "STEM").otherwise(F.initcap(rest("helpsteer3-"))))
    out = out.when(raw == "ifbench", F.coalesce(F.initcap(F.nullif(difficulty, F.lit(""))), F.lit("IFBench")))
    return out.when(raw == "ppe-ifeval", "PPE-IFEval").otherwise(raw)


# Fragments that shouldn't be a chunk of their own, and what they cost.
_SUBJECT = r"(?:The (?:response|answer)|Response [AB]|It|Both responses)(?:\s+(?:also|only|clearly|explicitly|directly))*"
FRAGMENTS = (
    (8.0, r"-\s*Criterion\s+\d+"),
    (8.0, r"(?:Not )?Met\.\s+(?:There|It|The(?: response)?)"),
    (8.0, r"Justification:\s*(?:The|A|An|This|That|Response)?"),
    (8.0, r"(?:Justification:\s*)?" + _SUBJECT),
    (4.0, _SUBJECT + r"\s+(?:is|are|was|were|has|have|does|provides|uses|mentions|contains|includes)"),
)
#: Longer fragments cost nothing.
FRAGMENT_TOKENS = 5


def fragment_penalty(fragment: Column, tokens: Column) -> Column:
    bare = strip(fragment)
    out = F.when(tokens > FRAGMENT_TOKENS, 0.0)
    for cost, pattern in FRAGMENTS:
        out = out.when(bare.rlike(rf"(?iU)^(?:{pattern})\z"), cost)
    return out.otherwise(0.0)


def shard_range(path: Column) -> tuple[Column, Column]:
    """The first and the next-after-last record that a shard's file name gives."""
    name = F.element_at(F.split(path, "/"), -1)
    part = lambda k: F.regexp_extract(name, r"^batch_([0-9]+)_([0-9]+)\.[a-z]+$", k).cast("long")
    return part(1), part(2)


def listed(csv: Column) -> Column:
    """Names between commas, each once, in order; blank ones not at all."""
    return F.array_distinct(F.filter(F.transform(F.split(csv, ","), strip), lambda x: x != ""))
