"""Shell command lines as SQL expressions: segments, program, subcommand, shape.

A command is cut into words and separators by one pattern, words between
separators form a segment, and a segment's program is its first word that is
not an assignment, a wrapper or a control word. Quoting is honoured; deep
nesting of substitutions is not. Commands without a program count as
``(unparsed)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SUBCOMMAND_PROGRAMS = [
    "git", "gh", "pnpm", "npm", "npx", "yarn", "cargo", "go", "docker", "kubectl", "aqua", "corepack",
]
SILENT_PROGRAMS = [
    "cd", "pushd", "popd", "echo", "printf", "true", "false", ":", "sleep", "touch", "mkdir", "exit",
]
CONTROL_WORDS = [
    "for", "while", "if", "until", "case", "select", "then", "else", "elif", "fi", "done", "esac", "do",
]
XARGS_VALUE_FLAGS = [
    "-I", "-L", "-n", "-P", "-s", "-d", "-a", "-E", "-l", "--replace", "--max-lines", "--max-args", "--max-procs",
]
NICE_VALUE_FLAGS = ["-n", "--adjustment"]
FILE_DUMPERS = ["cat", "head", "tail", "less", "more"]
UNPARSED = "(unparsed)"

W = "\u0001"  # ends a word
S = "\u0002"  # separates segments

_SINGLE = r"'[^']*+'?"
_DOUBLE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"?'
_SUBST = r"[$<>]\((?:[^()]|\([^()]*+\))*+\)?"
_TICKS = r"`[^`]*+`?"
_SPANS = rf"{_SINGLE}|{_DOUBLE}|{_SUBST}|{_TICKS}|\\."
TOKEN = rf"(?s)\|\||&&|[|;]|(?:{_SPANS}|&(?!&)|[^\s'\"`\\|;&$<>]++|[$<>])++"
QUOTES = r"""(?s)'([^']*+)'?|"([^"\\]*+(?:\\.[^"\\]*+)*+)"?|\\(.)"""

_ASSIGN = rf"[A-Za-z_][A-Za-z0-9_]*=[^{W}]*+{W}"
_FLAG = rf"-[^{W}]*+{W}"
PREFIX = (
    rf"^(?:{_ASSIGN})*+"
    rf"(?:env{W}(?:{_ASSIGN}|{_FLAG})*+"
    rf"|nice{W}(?:(?:{'|'.join(NICE_VALUE_FLAGS)}){W}[^{W}]*+{W}|{_FLAG})*+"
    rf"|xargs{W}(?:(?:{'|'.join(XARGS_VALUE_FLAGS)}){W}[^{W}]*+{W}|{_FLAG})*+"
    rf"|(?:time|command){W}(?:{_FLAG})*+)*+"
)
SEGMENT_TYPE = "array<struct<program:string,subcommand:string,reads_file:boolean>>"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unquoted(word: Column) -> Column:
    return F.regexp_replace(word, QUOTES, "$1$2$3")


def _masked(word: Column) -> Column:
    return F.regexp_replace(word, f"(?s){_SPANS}", "Q")


def _arguments(words: Column) -> Column:
    """Arguments without redirections and their targets."""

    def keep(word, i):
        mask = _masked(word)
        alone = r"^(\d*>{1,2}|\d*<{1,2}|&>{1,2})$"
        before = F.when(i > 0, _masked(F.get(words, i - 1)).rlike(alone)).otherwise(F.lit(False))
        return (
            F.when(mask.rlike(r"^\d*>&\d+$") | mask.rlike(alone) | before, F.lit(None).cast("string"))
            .when(mask.rlike(r"^(\d+|&)?[<>]"), F.lit(None).cast("string"))
            .when(mask.rlike("[<>]"), F.regexp_extract(mask, "^[^<>]+", 0))
            .otherwise(unquoted(word))
        )

    return F.filter(F.transform(words, keep), lambda a: a.isNotNull())


def _writes_file(words: Column) -> Column:
    def writes(word):
        mask = _masked(word)
        return mask.rlike(r"^(?:1?>{1,2}(?!&)|&>{1,2})") | mask.rlike(r"^[^<>]*[^<>\d&][^<>]*>{1,2}(?!&)")

    return F.exists(words, writes)


def _is_flag(word: Column) -> Column:
    return word.startswith("-")


def _reads_file(program: Column, args: Column) -> Column:
    takes_value = F.transform(
        args, lambda a, i: F.when(i > 0, F.get(args, i - 1).isin("-n", "-c")).otherwise(F.lit(False))
    )
    file_arg = F.exists(
        F.zip_with(args, takes_value, lambda a, skip: ~skip & ~_is_flag(a)), lambda hit: hit
    )
    at = F.array_position(F.transform(args, lambda a: a.rlike(r"^\d+,\d+p$")), F.lit(True))
    after = F.slice(args, (at + 1).cast("int"), F.size(args))
    range_print = (
        F.array_contains(args, "-n") & (at > 0) & F.exists(after, lambda a: ~_is_flag(a))
    )
    return (program.isin(*FILE_DUMPERS) & file_arg) | ((program == "sed") & range_print)


def _segment(text: Column) -> Column:
    words = F.filter(F.split(text, W), lambda w: w != "")

    def resolve(ws):
        plain = F.concat(F.array_join(F.transform(ws, unquoted), W), F.lit(W))
        rest = F.regexp_replace(plain, PREFIX, "")
        return F.struct(
            ws.alias("words"),
            F.coalesce(unquoted(F.get(ws, F.lit(0))).isin(*CONTROL_WORDS), F.lit(True)).alias("control"),
            F.substring_index(rest, W, 1).alias("program"),
            (F.size(ws) - (F.length(rest) - F.length(F.replace(rest, F.lit(W), F.lit(""))))).alias("skipped"),
        )

    def finish(r):
        program = F.when(~r["control"] & (r["program"] != "") & (F.size(r["words"]) > 0), r["program"])
        tail = F.slice(r["words"], (r["skipped"] + 2).cast("int"), F.size(r["words"]))
        return _let(
            F.struct(program.alias("program"), tail.alias("tail"), _arguments(tail).alias("args")),
            lambda x: F.struct(
                x["program"].alias("program"),
                F.when(
                    x["program"].isin(*SUBCOMMAND_PROGRAMS),
                    F.get(F.filter(x["args"], lambda a: ~_is_flag(a)), F.lit(0)),
                ).alias("subcommand"),
                F.coalesce(
                    _reads_file(x["program"], x["args"]) & ~_writes_file(x["tail"]), F.lit(False)
                ).alias("reads_file"),
            ),
        )

    return _let(_let(words, resolve), finish)


def segments(command: Column) -> Column:
    """One entry per part between ``|``, ``&&``, ``||`` and ``;``."""
    tokens = F.regexp_extract_all(command, F.lit(TOKEN), F.lit(0))
    joined = F.array_join(
        F.transform(tokens, lambda t: F.when(t.isin("|", "||", "&&", ";"), F.lit(S)).otherwise(t)), W
    )
    parts = F.transform(F.split(joined, S), _segment)
    return F.when(F.trim(command) == "", F.array().cast(SEGMENT_TYPE)).otherwise(parts.cast(SEGMENT_TYPE))


def primary(segs: Column) -> Column:
    """The segment the output of the whole call is put down to."""
    loud = F.filter(segs, lambda s: s["program"].isNotNull() & ~s["program"].isin(*SILENT_PROGRAMS))
    named = F.filter(segs, lambda s: s["program"].isNotNull() & (s["program"] != "cd"))
    return F.coalesce(F.get(loud, F.lit(0)), F.get(named, F.lit(0)))


# What a shape leaves out, in this order.
SHAPE_PATTERNS = [
    ("'[^']*'|\"[^\"]*\"", "<STR>"),
    (r"\b\d+(\.\d+)?\b", "<NUM>"),
    (r"(^|\s)([\w.@~-]*/[\w./@~-]*)", "$1<PATH>"),
]


def shape(command: Column) -> Column:
    """The command with quoted texts, numbers and paths replaced by placeholders."""
    out = command
    for pattern, placeholder in SHAPE_PATTERNS:
        out = F.regexp_replace(out, pattern, placeholder)
    return F.regexp_replace(F.trim(out), r"\s+", " ")
