"""Chat formatting by schema fingerprints, with DataFrame functions only (operator 3).

A record is a JSON text of any layout. Its nested field paths (``data.messages[].content[].text``)
are gathered at any depth; those that carry turns in some layout are sorted and hashed, and the
hash selects a declarative mapping, which gives canonical turns (role, text). Keys that no layout
knows (ids, names, metadata, whatever they hold) change no fingerprint. The template wraps each
turn in markers and escapes markers inside texts, so the text reads back exactly; the loss mask
marks the assistants' texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.batches import fresh

TURNS = "array<struct<role string, text string>>"
#: The parser's default refuses strings above 20,000,000 characters, and the whole record with them.
JSON = {"maxStringLen": "2147483647"}


@dataclass(frozen=True)
class Layout:
    """A layout: the field paths that identify it, those that may be missing, and where its turns are.

    ``each`` names an array by its path (empty: the root), the role's and the text's field within;
    a text field ``content[].text`` joins its parts, and a turn of a record in which it is a string, or holds strings among
    its parts, keeps those. ``lead`` names a text beside the array that becomes a first system turn unless empty. ``parts`` lists (role, fields) for layouts with
    one field a turn; several fields join with a blank line. Roles are mapped by ``ROLES`` unless ``verbatim``.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[tuple[str, ...], ...] = ()
    each: tuple[str, str, str] | None = None
    lead: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    verbatim: bool = False

    def path_sets(self) -> list[list[str]]:
        """The sorted path sets that records of this layout can have."""
        every = [c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return sorted({tuple(sorted({*self.paths, *(p for group in c for p in group)})) for c in every} - {()})


def _listed(name: str, array: str, role: str, text: str, **options) -> Layout:
    fields = tuple(f"{array}[].{f}" for f in (role, text)) + ((f"{array}[].{text.split('[]')[0]}",) if "[]" in text else ())
    lead = ((options["lead"],),) if "lead" in options else ()
    return Layout(name, (array,) if array else fields, (((fields,) if array else ()) + lead), each=(array, role, text), **options)


LAYOUTS = [
    _listed("messages", "messages", "role", "content", lead="system"),
    _listed("conversations", "conversations", "from", "value", lead="system"),
    _listed("turn list", "", "role", "content"),
    _listed("text list", "", "role", "text"),
    _listed("content parts", "messages", "role", "content[].text", lead="system"),
    _listed("wrapped messages", "data.messages", "role", "content"),
    _listed("speaker turns", "turns", "speaker", "said", verbatim=True),
    Layout("prompt", ("completion", "prompt"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt response", ("prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), (("input",),), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system instruction", ("instruction", "output", "system"), (("input",),), parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", ("answer", "question"), parts=(("user", ("question",)), ("assistant", ("answer",)))),
]
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

OPEN, TEXT, CLOSE = "<turn>", "<text>", "</turn>"


def _steps(path: str) -> list[str]:
    """The keys of a path; ``[]`` is a step of its own."""
    return [x for x in re.split(r"\.|(\[\])", path) if x]


def _name(steps: list[str]) -> str:
    return "".join(x if x == "[]" or not i else f".{x}" for i, x in enumerate(steps))


def skeleton(record: Column) -> Column:
    """A JSON text with all string values empty, so that no text can be taken for a structure."""
    plain = F.regexp_replace(record, r"\\(?s:.)", "_")  # no escaped quote is left
    keys = F.regexp_replace(plain, r'("[^"]*+"\s*+:)|"[^"]*+"', "$1")
    return F.regexp_replace(F.regexp_replace(keys, r":(?=\s*+[,}])", ':""'), r"(?<=[\[,])(?=\s*+[,\]])", '""')


def with_paths(df: DataFrame, record_col: str, name: str, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """``df`` with the sorted distinct field paths of a JSON column that carry turns in some layout.

    Objects and arrays are opened level by level down to the deepest such path; what leads to none is passed over.
    """
    known = {p for l in layouts for ps in l.path_sets() for p in ps}
    prefixes = {_name(_steps(p)[: i + 1]) for p in known for i in range(len(_steps(p)))}
    at, seen = fresh(df, "__at"), fresh(df, "__seen")
    node = "array<struct<path string, raw string>>"
    allowed = F.array(*[F.lit(p) for p in sorted(prefixes)])

    def open_(e: Column) -> Column:
        first = F.substring(F.ltrim(e["raw"]), 1, 1)
        dot = F.when(e["path"] == "", F.lit("")).otherwise(F.concat(e["path"], F.lit(".")))
        inside = F.transform(F.map_entries(F.from_json(e["raw"], "map<string,string>", JSON)), lambda kv: F.struct(F.concat(dot, kv["key"]).alias("path"), kv["value"].alias("raw")))
        items = F.transform(F.from_json(e["raw"], "array<string>", JSON), lambda x: F.struct(F.concat(e["path"], F.lit("[]")).alias("path"), x.alias("raw")))
        return F.coalesce(F.when(first == "{", inside).when(first == "[", items), F.array().cast(node))

    df = df.withColumn(at, F.array(F.struct(F.lit("").alias("path"), skeleton(F.col(record_col)).alias("raw"))).cast(node)).withColumn(seen, F.array().cast("array<string>"))
    for _ in range(max(len(_steps(p)) for p in known)):
        df = df.withColumn(at, F.filter(F.flatten(F.transform(at, open_)), lambda e: F.array_contains(allowed, e["path"])))
        df = df.withColumn(seen, F.array_union(seen, F.transform(at, lambda e: e["path"])))
    found = F.array_sort(F.filter(seen, lambda p: F.array_contains(F.array(*[F.lit(p) for p in sorted(known)]), p)))
    return df.withColumn(name, found).drop(at, seen)


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _ddl(steps: list[str], inner: str) -> str:
    """The type of a value under a path."""
    for x in reversed(steps):
        inner = f"array<{inner}>" if x == "[]" else f"struct<`{x}`:{inner}>"
    return inner


def _role(role: Column, layout: Layout) -> Column:
    role = F.coalesce(role, F.lit(""))
    return role if layout.verbatim else F.coalesce(F.create_map(*[F.lit(v) for kv in ROLES.items() for v in kv])[role], role)


def _mapped(layout: Layout, record: Column) -> Column:
    if layout.each:
        path, role, text = layout.each
        field, _, part = text.partition("[].")

        def array_of(kind: str, record: Column = record) -> Column:
            array = F.from_json(record, _ddl([*_steps(path), "[]"], f"struct<`{role}`:string,`{field}`:{kind}>"), JSON)
            for x in _steps(path):
                array = array[x]
            return array

        def turn(m: Column, text: Column) -> Column:
            return F.struct(_role(m[role], layout).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

        if part:
            # a field that is no array is null as one; in the skeleton, an element that is a string is empty and an object is not
            parts, bones, alone = array_of("array<string>"), array_of("array<string>", skeleton(record)), array_of("string")
            one = lambda x, bone: F.coalesce(F.when(F.startswith(bone, F.lit("{")), F.from_json(x, f"`{part}` string", JSON)[part]).otherwise(x), F.lit(""))
            joined = lambda m, i: F.array_join(F.zip_with(m[field], F.get(bones, i)[field], one), "")
            turns = F.transform(parts, lambda m, i: turn(m, F.when(m[field].isNotNull(), joined(m, i)).otherwise(F.get(alone, i)[field])))
        else:
            turns = F.transform(array_of("string"), lambda m: turn(m, m[field]))
        if not layout.lead:
            return turns
        lead = F.coalesce(F.from_json(record, f"`{layout.lead}` string", JSON)[layout.lead], F.lit(""))
        first = F.when(lead != "", F.array(F.struct(F.lit("system").alias("role"), lead.alias("text")))).otherwise(F.array().cast(TURNS))
        return F.concat(first, turns.cast(TURNS))
    names = sorted({f for _, fields in layout.parts for f in fields})
    row = F.from_json(record, ", ".join(f"`{n}` string" for n in names), JSON)
    parts = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[row[f] for f in fields]), lambda x: x != ""), "\n\n").alias("text")) for role, fields in layout.parts]
    return F.filter(F.array(*parts), lambda t: (t["role"] != "system") | (t["text"] != ""))


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` and ``turns`` (null for an unknown layout, also for null or broken JSON).

    The added columns replace input columns of those names. Repeated rows are mapped alike.
    """
    rest = [c for c in records.columns if c not in ("fingerprint", "layout", "turns")]
    record = fresh(records, "__record")
    paths = fresh(records, "__paths")
    base = with_paths(records.withColumn(record, F.col(record_col)), record, paths, layouts).select(*rest, record, fingerprint(F.col(paths)).alias("fingerprint"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for l in reversed(layouts):
        hit = F.col("fingerprint").isin(*[fingerprint(F.array(*[F.lit(p) for p in ps])) for ps in l.path_sets()])
        layout = F.when(hit, F.lit(l.name)).otherwise(layout)
        turns = F.when(hit, _mapped(l, F.col(record)).cast(TURNS)).otherwise(turns)
    made = base.select(*rest, "fingerprint", layout.alias("layout"), turns.alias("turns"))
    return made.withColumn("layout", F.when(F.col("turns").isNotNull(), F.col("layout")))


def escape(text: Column) -> Column:
    """A backslash doubles, and one goes into each marker after its first character."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"<(/?(?:turn|text)>)", r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segment(t: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(CLOSE + "\n"))


def format_turns(records: DataFrame, turns_col: str = "turns") -> DataFrame:
    """``records`` with ``formatted`` and ``loss_spans``: (turn, start within the turn's segment, length), in code points."""
    turns = F.col(turns_col)
    span = lambda t, i: F.struct(i.alias("turn"), (F.length(escape(t["role"])) + F.lit(len(OPEN) + len(TEXT))).alias("start"), F.length(escape(t["text"])).alias("length"), (t["role"] == "assistant").alias("loss"))
    spans = F.filter(F.transform(turns, span), lambda s: s["loss"])
    return records.withColumn("formatted", F.array_join(F.transform(turns, _segment), "")).withColumn("loss_spans", F.transform(spans, lambda s: F.struct(s["turn"], s["start"], s["length"])))


def segments(formatted: Column) -> Column:
    """The turns' segments of a formatted text, without their closing markers."""
    parts = F.split(formatted, CLOSE + "\n", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    def turn(s: Column) -> Column:
        halves = F.split(F.substr(s, F.lit(len(OPEN) + 1)), TEXT, 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(segments(formatted), turn)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    parts = segments(formatted)
    return F.transform(spans, lambda s: unescape(F.substr(F.get(parts, s["turn"]), s["start"] + 1, s["length"])))


#: Layouts that hold any turns, and those for a user's and an assistant's turn alone, in the order in which ``records_of_turns`` deals them.
LIST_LAYOUTS = ["messages", "conversations", "turn list", "text list", "content parts", "wrapped messages", "speaker turns"]
PAIR_LAYOUTS = ["prompt", "prompt response", "instruction", "question"]


def _record(name: str, id_: Column, turns: Column) -> Column:
    """Turns (``role``, ``content``) as a JSON text of a layout, with keys beside them that no mapping needs."""
    each = lambda role, text, **more: F.transform(turns, lambda t: F.struct(t["role"].alias(role), t["content"].alias(text)))
    text = lambda i: turns[i]["content"]
    other = F.create_map(*[F.lit(v) for kv in {"user": "human", "assistant": "gpt"}.items() for v in kv])
    half = lambda t: F.floor(F.length(t) / 2).cast("int")
    content = lambda t: F.array(F.struct(F.lit("text").alias("type"), F.substr(t, F.lit(1), half(t)).alias("text")), F.struct(F.lit("text").alias("type"), F.substr(t, half(t) + 1).alias("text")))
    made = {
        "messages": lambda: F.struct(each("role", "content").alias("messages")),
        "conversations": lambda: F.struct(id_.alias("id"), F.transform(turns, lambda t: F.struct(F.coalesce(other[t["role"]], t["role"]).alias("from"), t["content"].alias("value"))).alias("conversations")),
        "turn list": lambda: each("role", "content"),
        "text list": lambda: each("role", "text"),
        "content parts": lambda: F.struct(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), content(t["content"]).alias("content"))).alias("messages")),
        "wrapped messages": lambda: F.struct(F.struct(F.array(F.lit("a")).alias("messages"), id_.alias("prompt")).alias("meta"), F.struct(each("role", "content").alias("messages")).alias("data")),
        "speaker turns": lambda: F.struct(each("speaker", "said").alias("turns"), id_.alias("name")),
        "prompt": lambda: F.struct(text(0).alias("prompt"), text(1).alias("completion")),
        "prompt response": lambda: F.struct(id_.alias("id"), text(0).alias("prompt"), text(1).alias("response")),
        "instruction": lambda: F.struct(text(0).alias("instruction"), F.lit("").alias("input"), text(1).alias("output")),
        "question": lambda: F.struct(text(0).alias("question"), text(1).alias("answer"), F.struct(id_.alias("id")).alias("source")),
        "system instruction": lambda: F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output")),
    }[name]()
    return F.to_json(made, {"ignoreNullFields": "false"})


def records_of_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One JSON record per conversation from rows by turn, dealt over all layouts that can hold it by a digest of the id.

    Rows of equal turn are ordered by role and text; null turns come first, null roles and texts
    count as empty. Rows of a null id are one conversation, as nothing tells them apart. Columns not
    named are ignored. A role that other layouts would map (``ROLES``) goes to one that keeps roles as they are.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col(id_col).alias(id_col)).agg(F.sort_array(F.collect_list(one)).alias("__turns"))
    turns, roles = F.col("__turns"), F.transform("__turns", lambda t: t["role"])
    dealt = F.coalesce(F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(0))
    other = F.exists("__turns", lambda t: t["role"].isin(*ROLES))
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    triple = (roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))) & (turns[0]["content"] != "")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(dealt / n) % len(names) + 1).cast("int"))
    chosen = F.when(other, "speaker turns").when(pair & (dealt % 2 == 0), pick(PAIR_LAYOUTS, 2)).when(triple & (dealt % 2 == 0), "system instruction").otherwise(pick(LIST_LAYOUTS, 8))
    named = grouped.withColumn("__layout", chosen)
    record = F.lit(None).cast("string")
    for name in [*LIST_LAYOUTS, *PAIR_LAYOUTS, "system instruction"]:
        record = F.when(F.col("__layout") == name, _record(name, F.col(id_col).cast("string"), turns)).otherwise(record)
    return named.select(id_col, record.alias("record"))


def chat_digest(rows: DataFrame) -> DataFrame:
    """The contract's digest of each conversation, read back from the formatted output, and the layout it came in.

    Rows are taken as ``records_of_turns`` says: null texts and roles are empty, ties of turns are
    ordered, repeated rows are turns of their own, rows of a null id are one conversation, texts may
    be of any length. An empty table gives no rows; columns not named are ignored.
    """
    made = format_turns(canonical_turns(records_of_turns(rows)))
    back = made.select("conv_id", "layout", "formatted", read_back(F.col("formatted")).alias("back"), F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "layout",
    )
