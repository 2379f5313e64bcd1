"""Scalar text functions: answer scoring, replies as JSON or tags, names, prompts. All JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, articles, answers that must match whole, words that end counts.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = ("a", "an", "the")
WHOLE_ANSWERS = ("yes", "no", "noanswer")


def _let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def answer_tokens(c: Column) -> Column:
    """Tokens of a normalised answer: lower case, no ASCII punctuation, no articles."""
    bare = F.regexp_replace(F.lower(c), PUNCTUATION, "")
    return F.filter(F.split(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+"), lambda w: w != "")


def normalized_answer(c: Column) -> Column:
    return F.array_join(answer_tokens(c), " ")


def exact_match(prediction: Column, truth: Column) -> Column:
    return normalized_answer(prediction) == normalized_answer(truth)


def token_f1(prediction: Column, truth: Column) -> Column:
    """struct(f1, precision, recall) over token bags; whole answers that differ score 0."""
    zero = F.struct(F.lit(0.0).alias("f1"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))

    def score(p: Column, t: Column) -> Column:
        times = lambda bag, w: F.size(F.filter(bag, lambda x: x == w))
        same = F.aggregate(F.array_intersect(p, t), F.lit(0), lambda a, w: a + F.least(times(p, w), times(t, w))).cast("double")
        a, b = F.array_join(p, " "), F.array_join(t, " ")
        apart = (a.isin(*WHOLE_ANSWERS) | b.isin(*WHOLE_ANSWERS)) & (a != b)

        def out(n: Column) -> Column:
            precision, recall = n / F.size(p), n / F.size(t)
            return F.when(apart | (n == 0), zero).otherwise(F.struct((2 * precision * recall / (precision + recall)).alias("f1"), precision.alias("precision"), recall.alias("recall")))

        return F.when(F.size(p) * F.size(t) == 0, zero).otherwise(_let(same, out))

    return _let(answer_tokens(prediction), lambda p: _let(answer_tokens(truth), lambda t: score(p, t)))


def best_f1(prediction: Column, truths: Column) -> Column:
    """The greatest F1 against a list of truths; 0 for none."""
    return F.coalesce(F.array_max(F.transform(truths, lambda t: token_f1(prediction, t)["f1"])), F.lit(0.0))


def json_text(reply: Column) -> Column:
    """From the first `{` to the last `}` of a reply; null without both."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def parsed_reply(reply: Column, schema: str) -> Column:
    """The reply's JSON by a schema; null if it is none. Code fences and control characters don't matter."""
    clean = F.regexp_replace(json_text(reply), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.from_json(F.regexp_replace(clean, r"(?<=[:\[,]\s{0,4})None\b", "null"), schema)


def json_array(reply: Column, element: str) -> Column:
    """The JSON array between the first `[` and the last `]`."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit("")), f"array<{element}>")


def largest_json(reply: Column, keys: int = 1) -> Column:
    """Of the fenced blocks that are objects, the one with most keys; else the text between outer braces."""
    fenced = F.filter(F.regexp_extract_all(reply, F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1)), lambda x: F.size(F.json_object_keys(x)) >= keys)
    sized = F.transform(fenced, lambda x: F.struct(F.size(F.json_object_keys(x)).alias("n"), x.alias("x")))
    return F.coalesce(F.get(F.sort_array(sized, asc=False), F.lit(0))["x"], json_text(reply))


def tag_map(reply: Column) -> Column:
    """map(tag, value) of `<t>v</t>`; of equal tags the later wins."""
    pattern = r"(?s)<([A-Za-z_][\w-]*)>(.*?)</\1>"
    keys, values = (F.regexp_extract_all(reply, F.lit(pattern), F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(keys.alias("k"), F.transform(values, lambda v: F.trim(v)).alias("v"))
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(_let(pairs, last))


def tag_number(reply: Column, tag: str) -> Column:
    """A tag's value as a number, null if it is none."""
    return F.try_element_at(tag_map(reply), F.lit(tag)).try_cast("double")


#: How replies state an integer for a keyword, tried in this order whatever the case; a node's number may stand for it.
_NODE = r"(?:node[_\s-]?)?"
INTEGER_FORMS = (
    r"<\s*{k}\s*>\s*:?\s*" + _NODE + r"(-?\d+)", r"{k}:\s*" + _NODE + r"(-?\d+)", r"\*\*{k}\*\*\s*:?\s*" + _NODE + r"(-?\d+)",
    r"\*\*<\s*{k}\s*>\*\*:\s*" + _NODE + r"(-?\d+)", r"\*\*{k}:\*\*\s*" + _NODE + r"(-?\d+)", r"{k}\s*:?\s*(-?\d+)", r"{k}\s*:?\s*" + _NODE + r"(-?\d+)",
)
#: How replies name a node, in this order.
NODE_FORMS = (
    r"expand\s*node\s*(\d+)", r"node_id\s*:?\s*(\d+)", r"node\s*id\s*:?\s*(\d+)", r"suggested\s*node\s*:?\s*(\d+)", r"suggested_node_id\s*:?\s*(\d+)",
    r"expand\s*node\s*#?(\d+)", r"node\s*#?(\d+)", r"\"node_id\"\s*:\s*(\d+)", r"\"suggested_node_id\"\s*:\s*(\d+)",
)


def integer_for(reply: Column, keyword: str, allowed: list[int] | None = None) -> Column:
    """The integer that a reply gives for a keyword, by the first form that matches with an allowed one; else null."""
    found = [F.regexp_extract(reply, "(?is)" + f.replace("{k}", keyword), 1).try_cast("int") for f in INTEGER_FORMS]
    return F.coalesce(*[x if allowed is None else F.when(x.isin(*allowed), x) for x in found])


def node_id(reply: Column) -> Column:
    """The node that a reply names, by the first form that matches; else null."""
    return F.coalesce(*[F.regexp_extract(reply, "(?is)" + f, 1).try_cast("int") for f in NODE_FORMS])


def duration(seconds: Column) -> Column:
    """HHh:MMm:SSs, without the hours if there are none, and without the minutes if there are neither."""
    s = F.floor(seconds).cast("long")
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    part = lambda x, unit: F.format_string(f"%02d{unit}", x)
    return F.concat_ws(":", F.when(hours > 0, part(hours, "h")), F.when((hours > 0) | (minutes > 0), part(minutes, "m")), part(s % 60, "s"))


def stamp(at: Column) -> Column:
    """A time as the start of a file's name."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def call_id(name: Column, arguments_json: Column) -> Column:
    """A tool call's id: 8 hex digits of the SHA-256 of its name and its arguments (keys sorted by the caller)."""
    return F.concat(F.lit("call_"), F.substring(F.sha2(F.concat(name, arguments_json), 256), 1, 8))


def word_count(c: Column) -> Column:
    """The default token count: runs between white space."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def docstring(code: Column, kind: str = "def") -> Column:
    """A class's or function's docstring by pattern."""
    return F.nullif(F.trim(F.regexp_extract(code, r"(?s)^\s*(?:async\s+)?" + kind + r"\s+\w+[^\n]*:\s*\n\s*(\"\"\"|''')(.*?)\1", 2)), F.lit(""))


def called_names(line: Column) -> Column:
    """Names before brackets in a line, keywords left out."""
    keywords = ("if", "for", "while", "return", "def", "class", "print", "elif", "with", "and", "or", "not", "in", "lambda", "except", "assert", "yield", "await", "del", "raise")
    return F.filter(F.regexp_extract_all(line, F.lit(r"([A-Za-z_][\w.]*)\s*\("), F.lit(1)), lambda x: ~x.isin(*keywords))


def first_sentence(doc: Column) -> Column:
    return F.split_part(doc, F.lit("."), F.lit(1))


def last_part(qualified: Column) -> Column:
    return F.element_at(F.split(qualified, r"\."), -1)


def import_name(module: Column, name: Column) -> Column:
    return F.concat_ws(".", F.nullif(module, F.lit("")), name)


def is_constant(name: Column) -> Column:
    """All letters are capitals, one at least, and an underscore."""
    return (name == F.upper(name)) & name.rlike("[A-Z]") & F.contains(name, F.lit("_"))


def compact(c: Column) -> Column:
    """Without spaces, tabs and newlines."""
    return F.translate(c, " \t\n", "")


def contains_compact(text: Column, needle: Column) -> Column:
    return F.contains(compact(text), compact(needle))


def content_hash(text: Column, meta: Column | None = None) -> Column:
    """SHA-256 of the text without white space and case, and of metadata without its line numbers."""
    body = F.lower(F.regexp_replace(text, r"\s+", ""))
    return F.sha2(body if meta is None else F.concat(body, F.coalesce(meta, F.lit(""))), 256)


def code_list(codes: Column) -> Column:
    """Code pieces for a prompt, each numbered and fenced."""
    return F.array_join(F.transform(codes, lambda c, i: F.format_string("Code %d:\n```\n%s\n```", i + 1, c)), "\n\n")


def rag_prompt(question: Column, context: Column) -> Column:
    return F.format_string("Answer the question from the code below. Reply as JSON with thought, ground_truth, answer.\n\nQuestion: %s\n\n%s", question, context)


def judge_prompt(question: Column, answer: Column, truth: Column) -> Column:
    return F.format_string("Score the answer from 1 to 5. Reply as JSON with score, reasoning.\n\nQuestion: %s\nAnswer: %s\nReference: %s", question, answer, F.coalesce(truth, F.lit("")))


def ends_in_order(reply: Column, marks: tuple[str, ...] = ("Thought:", "Action:")) -> Column:
    """Each section mark is there, in this order."""
    places = [F.instr(reply, m) for m in marks]
    ok = places[0] > 0
    for a, b in zip(places, places[1:]):
        ok = ok & (b > a)
    return ok


def cleaned_argument(c: Column) -> Column:
    return F.nullif(c, F.lit("null"))


#: Comment marks by language, media types by suffix.
COMMENT_MARKS = {"#": ("python", "ruby", "perl", "r", "bash", "shell", "yaml", "toml", "make", "dockerfile", "elixir", "julia", "nim", "powershell", "tcl", "coffeescript"), "//": ("java", "javascript", "typescript", "c", "cpp", "c++", "c#", "csharp", "go", "rust", "swift", "kotlin", "scala", "php", "dart", "groovy", "objective-c", "zig", "solidity", "fsharp"), "--": ("sql", "lua", "haskell", "ada", "elm", "vhdl", "applescript"), ";": ("lisp", "clojure", "scheme", "assembly", "ini"), "%": ("matlab", "latex", "tex", "erlang", "prolog", "octave"), "'": ("vb", "vba", "visual basic"), "!": ("fortran",)}
MEDIA_TYPES = {".py": "text/x-python", ".java": "text/x-java", ".md": "text/markdown", ".txt": "text/plain", ".json": "application/json", ".html": "text/html", ".css": "text/css", ".js": "text/javascript", ".csv": "text/csv", ".xml": "application/xml", ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml", ".zip": "application/zip"}


def comment_mark(language: Column) -> Column:
    out = F.lit("//")
    for mark, names in COMMENT_MARKS.items():
        out = F.when(F.lower(language).isin(*names), F.lit(mark)).otherwise(out)
    return out


def media_type(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for suffix, kind in MEDIA_TYPES.items():
        out = F.when(F.lower(path).endswith(suffix), F.lit(kind)).otherwise(out)
    return out


def index_name(repo: Column, commit: Column) -> Column:
    return F.concat_ws("_", F.replace(repo, F.lit("/"), F.lit("_")), F.substring(commit, 1, 7))


def usage_total(payload: Column) -> Column:
    """struct(cost, prompt, completion, cached) of a provider's usage JSON in any of its spellings; missing: 0."""
    first = lambda kind, *paths: F.coalesce(*[F.get_json_object(payload, p).try_cast(kind) for p in paths], F.lit(0).cast(kind))
    return F.struct(
        first("double", "$.cost", "$.completion_cost", "$.total_cost").alias("cost"),
        first("long", "$.prompt_tokens", "$.input_tokens").alias("prompt_tokens"),
        first("long", "$.completion_tokens", "$.output_tokens").alias("completion_tokens"),
        first("long", "$.cached_tokens", "$.cache_read_input_tokens", "$.prompt_tokens_details.cached_tokens").alias("cached_tokens"),
    )
