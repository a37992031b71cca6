"""Operator 4: chat formatting with schema fingerprints.

Each record's nested field paths are hashed; the hash selects a declarative mapping from that layout to canonical turns.
The turns are written in one template, whose control strings are escaped where a text holds them, with the spans of
assistant text as loss mask; parse() reads turns and mask back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin

#: Layouts: either `turns` with the paths of role and text in its items (and other names of roles), or `fields`, each
#: the text of one turn of a role, in order; empty optional fields make no turn.
MAPPINGS = [
    {"name": "messages", "turns": "messages", "role": "role", "text": "content"},
    {"name": "conversations", "turns": "conversations", "role": "from", "text": "value", "roles": {"human": "user", "gpt": "assistant"}},
    {"name": "prompt_response", "fields": [("user", "prompt"), ("assistant", "response")]},
    {"name": "prompt_completion", "fields": [("user", "prompt"), ("assistant", "completion")]},
    {"name": "system_prompt_response", "fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"name": "instruction_output", "fields": [("user", "instruction"), ("assistant", "output")]},
    {"name": "instruction_input_output", "fields": [("user", "instruction"), ("user", "input"), ("assistant", "output")], "optional": ["input"]},
    {"name": "question_answer", "fields": [("user", "question"), ("assistant", "answer")]},
    {"name": "nested_prompt", "fields": [("user", "data.prompt"), ("assistant", "data.response")]},
]
#: The template's control strings. Turns of user, assistant and system have their own; others carry their role's name.
CONTROL = r"</?s>|\[/?INST\]|\[/?SYS\]|\[/?OUT\]|\[TURN |\[/TURN\]"
_MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
_ESCAPE, _UNESCAPE = re.compile(rf"(\\*)({CONTROL})"), re.compile(rf"(\\+)({CONTROL})")
_TURN = re.compile(r"(?<!\\)(?:\[INST\] (?P<user>.*?) (?<!\\)\[/INST\]|\[OUT\] (?P<assistant>.*?) (?<!\\)</s>|\[SYS\] (?P<system>.*?) (?<!\\)\[/SYS\]|\[TURN (?P<role>(?:[^\]\\]|\\.)*)\] (?P<other>.*?) (?<!\\)\[/TURN\])\n", re.S)


def paths(value) -> set[str]:
    """The nested field paths of a record; the items of an array share the path that ends in [], items that are no objects
    or arrays [].*, and an empty array has the path itself. Any depth will do."""
    out, open_ = set(), [(value, "")]
    while open_:
        v, at = open_.pop()
        if isinstance(v, dict) and v:
            open_ += [(x, f"{at}.{k}" if at else k) for k, x in v.items()]
        elif isinstance(v, list):
            open_ += [(x, f"{at}[]") for x in v] or [(None, f"{at}[]")]
            if any(not isinstance(x, (dict, list)) for x in v):
                out.add(f"{at}[].*")
        else:
            out.add(at)
    return out


def fingerprint(found: set[str]) -> int:
    """The hash of a layout's paths."""
    return xxhash.xxh64_intdigest("\n".join(sorted(found)).encode("utf-8", "surrogatepass"))


def _needs(mapping: dict) -> set[str]:
    if "turns" in mapping:
        return {f"{mapping['turns']}[].{mapping['role']}", f"{mapping['turns']}[].{mapping['text']}"}
    return {p for _, p in mapping["fields"] if p not in mapping.get("optional", ())}


def choose(found: set[str], mappings: list[dict] = MAPPINGS) -> dict | None:
    """The mapping whose paths a layout has; of several the one that uses most of them, then the earlier. A mapping of
    turns fits an empty list of turns too, but no list with items that aren't objects."""
    plain = lambda m: "turns" in m and f"{m['turns']}[].*" in found
    fits = [m for m in mappings if not plain(m) and (_needs(m) <= found or "turns" in m and f"{m['turns']}[]" in found)]
    return max(fits, key=lambda m: len(_needs(m) | {p for _, p in m.get("fields", ())} & found), default=None)


def _held(text: str) -> str:
    """The text as UTF-8 can hold it: halves of a surrogate pair are joined, lone ones become U+FFFD."""
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def canonical(value, mapping: dict) -> list[tuple[str, str]]:
    """(role, text) of each turn; a null or missing text is the empty one."""

    def get(v, path: str):
        for k in path.split("."):
            v = v.get(k) if isinstance(v, dict) else None
        return v if v is None else _held(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))

    if "turns" in mapping:
        roles = mapping.get("roles", {})
        return [(roles.get(r, r), get(x, mapping["text"]) or "") for x in value[mapping["turns"]] or [] for r in [get(x, mapping["role"]) or ""]]
    return [(role, get(value, p) or "") for role, p in mapping["fields"] if p not in mapping.get("optional", ()) or get(value, p)]


def escape(text: str) -> str:
    """Backslashes before a control string are doubled and one more is put there; nothing else changes."""
    return _ESCAPE.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def _role(name: str) -> str:
    return re.sub(r"([\]\\])", r"\\\1", name)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of assistant text in it."""
    out, at, spans = ["<s>\n"], 4, []
    for role, text in turns:
        a, b = _MARKS.get(role) or (f"[TURN {_role(role)}] ", " [/TURN]")
        text = escape(text)
        if role == "assistant":
            spans.append((at + len(a), at + len(a) + len(text)))
        out += [a, text, b, "\n"]
        at += len(a) + len(text) + len(b) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that render() was given."""
    out = []
    for m in _TURN.finditer(formatted, 4):
        kind = m.lastgroup
        if kind == "other":
            out.append((re.sub(r"\\(.)", r"\1", m["role"], flags=re.S), unescape(m["other"])))
        else:
            out.append((kind, unescape(m[kind])))
    return out


def format_records(records: DataFrame, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """(id, layout, formatted, loss array<struct<start, end>>) of each JSON record.

    A record that is null, no JSON, nested deeper than the JSON reader goes or of no known layout has a null layout and
    null texts, so it can be told from an empty conversation; lone surrogates become U+FFFD; equal rows give equal rows,
    and no rows none. Other columns, whatever their names, play no part.
    """
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("id", pa.int64()), ("layout", pa.string()), ("formatted", pa.string()), ("loss", spans)])
    rows = records.select(F.col(id_col).alias("id"), F.col(json_col).alias("record"))

    def formatted(raw: str | None, known: dict[int, dict | None]) -> tuple:
        try:
            value = json.loads(raw) if raw is not None else None
            if not isinstance(value, dict):
                return None, None, None
            found = paths(value)
            print_ = fingerprint(found)
            if print_ not in known:
                known[print_] = choose(found)
            mapping = known[print_]
            if mapping is None:
                return None, None, None
            text, loss = render(canonical(value, mapping))
            return mapping["name"], text, [{"start": a, "end": b} for a, b in loss]
        except (ValueError, RecursionError):
            return None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        known: dict[int, dict | None] = {}
        for batch in batches:
            out = [(i, *formatted(raw, known)) for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)

    return rows.mapInArrow(run, "id long, layout string, formatted string, loss array<struct<start: long, end: long>>")


def records(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, record): the conversations of a table of turns as JSON records, each in the plainest layout that holds it:
    a prompt and its response, the same with a system text, alternating voices, or messages. Turns of one number stand in
    the order of role and text; null roles and texts are empty ones; rows of a null id are one conversation; a conversation
    is gathered in one row, so it has to fit a task."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    each = turns.select(F.col(id_col).alias("id"), turn.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    roles, text = F.col("t.role"), lambda i: F.col("t")[i]["text"]
    pair = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    led = F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response")))
    voices = F.to_json(F.struct(F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"), x["text"].alias("value"))).alias("conversations")))
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    two = F.array(F.lit("user"), F.lit("assistant"))
    record = F.when(roles == two, pair).when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), led).when(F.size(F.array_except(roles, two)) == 0, voices).otherwise(messages)
    return each.select("id", record.alias("record"))


def digests(formatted: DataFrame) -> DataFrame:
    """formatted(id, formatted, loss) -> (id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all from
    the formatted text and its mask."""
    schema = pa.schema([("id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, loss in zip(*(batch.column(k).to_pylist() for k in range(3))):
                turns, h = parse(text), hashlib.sha256()
                for role, x in turns:
                    h.update(f"{role}\n{x}\n".encode("utf-8", "surrogatepass"))
                masked = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                out.append((i, len(turns), h.hexdigest(), len(masked), hashlib.sha256(masked.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)

    return formatted.select("id", "formatted", "loss").mapInArrow(run, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
