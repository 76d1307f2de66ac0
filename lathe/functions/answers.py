"""Answer normalisers and rule scorers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lathe.functions import text as T

# Fixed values of the quantitative-answer normaliser: replacements, then removals, in order.
REPLACED = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = ["square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots"]
# Fixed patterns of the same normaliser's last steps (Java regular expressions).
UNWRAPPED = [
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
    (r"(\\text\{)(.*?)(\})", "$2"),
    (r"(\\textbf\{)(.*?)(\})", "$2"),
    (r"(\\overline\{)(.*?)(\})", "$2"),
    (r"(\\boxed\{)(.*)(\})", "$2"),
    (r"(frac)([^{])(.)", r"frac{$2}{$3}"),
    (r"(sqrt)([^{])", r"sqrt{$2}"),
]


def plain(col: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)


def quantity(answer: Column) -> Column:
    """Normal form of a quantitative answer: what follows the last ``=``, without units, spacing and wrappers."""
    s = plain(F.substring_index(answer, "=", -1), [*REPLACED, *((x, "") for x in REMOVED)])
    s = F.replace(T.chain(s, UNWRAPPED), F.lit("$"), F.lit(""))
    bare = F.replace(s, F.lit(","), F.lit(""))
    return F.trim(F.when(bare.rlike("^[0-9]+$"), bare).otherwise(s))


def math_form(answer: Column) -> Column:
    """Normal form of a competition answer: fractions, roots and decimals spelled one way."""
    s = plain(answer, [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")])
    s = F.when(F.contains(s, F.lit("\\text{ ")), F.substring_index(s, "\\text{ ", 1)).otherwise(s)
    s = plain(s, [("\\%", ""), ("%", ""), (" .", " 0."), ("{.", "{0.")])
    s = F.when(s.startswith("."), F.concat(F.lit("0"), s)).otherwise(s)
    s = F.when(s.rlike("^[^=]{0,2}=[^=]*$"), F.substring_index(s, "=", -1)).otherwise(s)
    s = F.replace(F.regexp_replace(s, r"\\sqrt([^{])", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))
    s = F.regexp_replace(F.regexp_replace(s, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")
    s = F.when(s == "0.5", F.lit("\\frac{1}{2}")).otherwise(s)
    return F.regexp_replace(s, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}")


def gsm8k_score(text: Column, gold: Column, strict: bool = True, format_score: float = 0.0) -> Column:
    """1 for an equal answer string, ``format_score`` for another one, 0 for none."""
    answer = T.hash_answer(text) if strict else T.last_number(text)
    return F.when(answer.isNull(), 0.0).when(answer == gold, 1.0).otherwise(float(format_score))


def math_score(text: Column, gold: Column) -> Column:
    """1 if the last boxed answer has the gold's normal form."""
    return F.when(math_form(T.boxed(text)) == math_form(gold), 1.0).otherwise(0.0)


def dapo_score(text: Column, gold: Column, strict_box: bool = False) -> Column:
    """struct(score, acc, pred): +1 or -1 by the last ``Answer:`` line of the last 300 characters, or by the last box of the last 100."""
    end = F.right(text, F.lit(300))
    if strict_box:
        pred = T.boxed(F.right(end, F.lit(100)))
        acc = F.coalesce(pred == gold, F.lit(False))
    else:
        lines = F.regexp_extract_all(end, F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
        pred = quantity(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("[INVALID]")))
        acc = pred == quantity(gold)
    return F.struct(F.when(acc, 1.0).otherwise(-1.0).alias("score"), acc.alias("acc"), pred.alias("pred"))


def strict_box_score(text: Column, gold: Column) -> Column:
    """1 if exactly one box is there and it has the gold's normal form: the string stand-in for symbolic equality."""
    boxes = F.size(F.split(text, r"\\boxed\{|\\fbox\{", -1)) - 1
    return F.when((boxes == 1) & (math_form(T.boxed(F.replace(text, F.lit("\\fbox{"), F.lit("\\boxed{")))) == math_form(gold)), 1.0).otherwise(0.0)


def qa_score(text: Column, golds: Column, format_score: float = 0.0, contains: bool = False) -> Column:
    """1 for a match of the last answer element, a quarter of that if more than 10 elements open, 0 without one."""
    answer = T.last_answer(text)
    hit = T.contains_match(answer, golds) if contains else T.exact_match(answer, golds)
    many = F.size(F.split(text, "<answer>", -1)) - 1 > 10
    return F.when(answer.isNull(), 0.0).when(hit, F.when(many, 0.25).otherwise(1.0)).otherwise(float(format_score))


def format_reward(text: Column, gold: Column, high: float = 1.0, low: float = 0.0) -> Column:
    """``high`` where the text has the think / tool_call / response frame that the gold has, each tag once."""
    once = lambda *tags: reduce(lambda a, b: a & b, [F.size(F.split(text, t, -1)) == 2 for t in tags])
    call, resp = F.contains(gold, F.lit("<tool_call>")), F.contains(gold, F.lit("<response>"))
    tc, rs = ("<tool_call>", "</tool_call>"), ("<response>", "</response>")
    ok = (
        F.when(resp & ~call, text.rlike(r"(?s)^<think>.*?</think>\n<response>.*?</response>$") & once(*rs))
        .when(~resp & call, text.rlike(r"(?s)^<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>$") & once(*tc))
        .when(resp & call, text.rlike(r"(?s)^<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>\n<response>.*?</response>$") & once(*tc, *rs))
        .otherwise(text.rlike(r"(?s)^<think>.*?</think>$"))
    )
    return F.when(ok, float(high)).otherwise(float(low))


def overlong_penalty(length: Column, limit: int, buffer: int, factor: float = 1.0) -> Column:
    """0 up to ``limit - buffer`` tokens, then falling by ``factor`` over the buffer."""
    return F.least(-(length - (limit - buffer)) / float(buffer) * factor, F.lit(0.0))


def multiset_similarity(a: Column, b: Column) -> Column:
    """Shared elements, counted as often as both hold them, over the union; equal arrays 1, an empty one 0."""
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


NUMBER = r"[0-9]+(?:[.][0-9]*)?|[.][0-9]+"
# Scale words and units of the value normaliser.
SCALES = [("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter"]


def bare_value(answer: Column) -> Column:
    """An answer without its unit, currency, percent sign and enclosing text or braces; scale words as powers of ten; lower case."""
    s = F.regexp_replace(F.trim(answer), r"^\\text\{(.+?)\}$", "$1")
    s = plain(s, [("\\%", ""), ("\\$", ""), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), *SCALES])
    for unit in UNITS:
        s = F.regexp_replace(s, unit + r"(es)?(s)? *(\^[0-9]+)?", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\^ *\\circ", ""), r",\\! *", "")
    s = F.when(s.rlike(r"^\{.*\}$"), F.regexp_extract(s, r"^\{(.*)\}$", 1)).otherwise(s)
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(s, "- *", "-"), r"([0-9]),(?=[0-9]{3}(?:[^0-9]|$))", "$1")))


def number_of(value: Column) -> Column:
    """The value of a number, fraction, mixed number, root, multiple of pi or scaled number, as a double; null for anything else."""
    s = F.regexp_replace(bare_value(value), r"\\[dt]frac", r"\\\\frac")
    def parsed(t):
        get = lambda pattern, i: F.nullif(F.regexp_extract(t, pattern, i), F.lit("")).try_cast("double")
        sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
        plain_ = rf"^-?({NUMBER})$"
        scaled = rf"^-?({NUMBER})\s*\*\s*10\^\{{?([0-9]+)\}}?$"
        ratio = rf"^-?(?:\\frac\{{(-?(?:{NUMBER}))\}}\{{({NUMBER})\}}|({NUMBER})\s*/\s*({NUMBER}))$"
        mixed = rf"^-?([0-9]+)\s*(?:\\frac\{{({NUMBER})\}}\{{({NUMBER})\}}|\s([0-9]+)/([0-9]+))$"
        root = rf"^-?({NUMBER})?\s*\\sqrt(?:\{{({NUMBER})\}}|([0-9]))$"
        pi = rf"^-?({NUMBER})?\s*\\pi$"
        over = lambda a, b: F.when(b != 0, a / b)
        return (
            F.when(t.rlike(plain_), sign * get(plain_, 1))
            .when(t.rlike(scaled), sign * get(scaled, 1) * F.pow(F.lit(10.0), get(scaled, 2)))
            .when(t.rlike(ratio), sign * over(F.coalesce(get(ratio, 1), get(ratio, 3)), F.coalesce(get(ratio, 2), get(ratio, 4))))
            .when(t.rlike(mixed), sign * (get(mixed, 1) + over(F.coalesce(get(mixed, 2), get(mixed, 4)), F.coalesce(get(mixed, 3), get(mixed, 5)))))
            .when(t.rlike(root), sign * F.coalesce(get(root, 1), F.lit(1.0)) * F.sqrt(F.coalesce(get(root, 2), get(root, 3))))
            .when(t.rlike(pi), sign * F.coalesce(get(pi, 1), F.lit(1.0)) * F.lit(3.141592653589793))
        )

    return F.transform(F.array(s), parsed)[0]


def close(a: Column, b: Column, relative: float = 1e-4) -> Column:
    """Two numbers within the relative distance, also where one of them is a percentage of the other."""
    near = lambda x, y: F.abs(x - y) <= relative * F.greatest(F.abs(x), F.abs(y))
    return near(a, b) | near(a, b / 100) | near(a, b * 100)


def same_value(prediction: Column, gold: Column) -> Column:
    """Whether two answers are one value: equal normal forms, close numbers, or tuples and intervals whose brackets are alike and whose parts are.

    The value subset of symbolic equality: expressions with variables are compared by
    their normal form only.
    """
    shape = r"(?s)^\s*([(\[])(.*)([)\]])\s*$"
    parts = lambda t: F.split(F.regexp_extract(t, shape, 2), r",(?![0-9]{3}(?:[^0-9]|$))", -1)
    edges = lambda t: F.concat(F.regexp_extract(t, shape, 1), F.regexp_extract(t, shape, 3))
    one = lambda x, y: F.coalesce((math_form(F.trim(x)) == math_form(F.trim(y))) | (bare_value(x) == bare_value(y)), F.lit(False)) | F.coalesce(close(number_of(x), number_of(y)), F.lit(False))

    def judged(p):
        a, b = p["a"], p["b"]
        pairs = F.zip_with(parts(a), parts(b), lambda x, y: one(x, y))
        tuples = (edges(a) == edges(b)) & (F.size(parts(a)) == F.size(parts(b))) & F.forall(pairs, lambda x: x)
        return F.when(a.isNull() | b.isNull(), F.lit(False)).when(a.rlike(shape) & b.rlike(shape), tuples).otherwise(one(a, b))

    return F.transform(F.array(F.struct(prediction.alias("a"), gold.alias("b"))), judged)[0]


def strict_value_score(text: Column, gold: Column) -> Column:
    """1 if exactly one box is there and it is the gold's value."""
    boxes = F.size(F.split(text, r"\\boxed\{|\\fbox\{", -1)) - 1
    return F.when((boxes == 1) & same_value(T.boxed(F.replace(text, F.lit("\\fbox{"), F.lit("\\boxed{"))), gold), 1.0).otherwise(0.0)


def marked_answer(text: Column) -> Column:
    """What follows the last ``answer:``, ``answer is`` or ``answers are`` on its line, without a final point, or the box in it, if that holds a digit; else the last box; else null."""
    found = F.regexp_extract(text, r"(?is)^.*(?:answer:|answer is|answers are)[ \t]*([^\n]*)", 1)
    found = F.trim(F.regexp_replace(found, r"\.\s*$", ""))
    found = F.coalesce(T.boxed(found), found)
    return F.coalesce(F.when(found.rlike("[0-9]"), found), T.boxed(text))


def case_score(passed: Column, continuous: bool = False, most: int = 10) -> Column:
    """Score of a program by its cases' results: 1 if all hold; else 0, or the share that hold of the first ``most``. A null result doesn't hold."""
    first = F.slice(passed, 1, most)
    share = F.size(F.filter(first, lambda x: F.coalesce(x, F.lit(False)))) / F.greatest(F.size(first), F.lit(1))
    whole = F.forall(passed, lambda x: F.coalesce(x, F.lit(False)))
    return F.when(whole, 1.0).otherwise(share if continuous else F.lit(0.0))


SCORERS = {"openai/gsm8k": gsm8k_score, "strict_value": strict_value_score, "math": math_score, "dapo": lambda t, g: dapo_score(t, g)["score"], "strict_box": strict_box_score, "searchqa": lambda t, g: qa_score(t, F.array(g))}


def register(name: str, scorer) -> None:
    if SCORERS.get(name, scorer) is not scorer:
        raise ValueError(f"scorer {name!r} is registered already")
    SCORERS[name] = scorer


def score(data_source: Column, text: Column, gold: Column) -> Column:
    """Score by the row's data source; an unknown source raises."""
    pick = None
    for name, fn in SCORERS.items():
        pick = (F if pick is None else pick).when(data_source == name, fn(text, gold))
    return pick.otherwise(F.raise_error(F.concat(F.lit("no scorer for "), data_source)).cast("double"))
