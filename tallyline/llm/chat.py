"""Chat formatting with schema fingerprints, in DataFrame functions only.

The nested field paths that a row fills are hashed; the hash selects one of a list of declared
mappings, which turns the row into canonical turns (role, text). The turns of a conversation are
then written into one string under a template, with the spans that a loss counts.

Template: ``### role: text</turn>`` and a newline for each turn. Inside roles and texts a backslash
is put into every control string, and backslashes are doubled, so the string can be read back
whatever the texts say.

Null roles and texts count as empty, turns without a number come first, equal numbers are ordered by
role and text. Contents in several parts are joined, parts without text left out. Rows that no mapping
fits, whatever the shape and types of their fields, have no layout: `canonical_turns` leaves them to
`unmapped_rows`. A conversation is one output row, so it must fit into a task; nothing else is gathered.
"""

from itertools import combinations

from pyspark.sql import Window, functions as F, types as T

END, HEAD, SEP = "</turn>\n", "### ", ": "
LEARNED = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def _turn(role, text):
    return F.struct(*[F.coalesce(part.cast("string"), F.lit("")).alias(name) for part, name in ((role, "role"), (text, "text"))])


def _role(name):
    """The canonical name of a role that another layout calls differently."""
    known = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
    found = name
    for other, role in known.items():
        found = F.when(name == other, F.lit(role)).otherwise(found)
    return found


def _pair(asked, answered):
    return F.array(_turn(F.lit("user"), asked), _turn(F.lit("assistant"), answered))


#: name, paths that must be filled, paths that may be, and the turns as a function of a column getter
MAPPINGS = [
    ("turn rows", [], ["turn", "role", "text"], lambda c: F.array(_turn(c("role"), c("text")))),
    ("messages", ["messages[].role", "messages[].content"], [], lambda c: F.transform(
        c("messages"), lambda m: _turn(m["role"], m["content"]))),
    ("message parts", ["messages[].role", "messages[].content[].text"], ["messages[].content[].type"], lambda c: F.transform(
        c("messages"), lambda m: _turn(m["role"], F.array_join(m["content"]["text"], "")))),
    ("message lists", ["messages[].role", "messages[].content[]"], [], lambda c: F.transform(
        c("messages"), lambda m: _turn(m["role"], F.array_join(m["content"], "")))),
    ("shared turns", ["conversations[].from", "conversations[].value"], [], lambda c: F.transform(
        c("conversations"), lambda m: _turn(_role(m["from"]), m["value"]))),
    ("prompt", ["prompt", "response"], [], lambda c: _pair(c("prompt"), c("response"))),
    ("completion", ["prompt", "completion"], [], lambda c: _pair(c("prompt"), c("completion"))),
    ("instruction", ["instruction", "output"], ["input"], lambda c: _pair(
        F.concat_ws("\n", c("instruction"), F.when(c("input") != "", c("input"))), c("output"))),
    ("system instruction", ["system", "instruction", "output"], ["input"], lambda c: F.concat(
        F.array(_turn(F.lit("system"), c("system"))),
        _pair(F.concat_ws("\n", c("instruction"), F.when(c("input") != "", c("input"))), c("output")))),
]


def _leaves(kind):
    """(path below a column of a type, condition on the column that it holds a value) for every leaf."""
    if isinstance(kind, T.StructType):
        for field in kind:
            for path, holds in _leaves(field.dataType):
                yield f".{field.name}{path}", lambda c, holds=holds, name=field.name: holds(c[name])
    elif isinstance(kind, T.ArrayType):
        for path, holds in _leaves(kind.elementType):
            yield f"[]{path}", lambda c, holds=holds: F.exists(c, lambda element: F.coalesce(holds(element), F.lit(False)))
    else:
        yield "", lambda c: c.isNotNull()


def _paths(schema, skip):
    """{path: condition that a row fills it} for every leaf of a schema."""
    return {
        field.name + path: holds(F.col(f"`{field.name}`"))
        for field in schema if field.name not in skip for path, holds in _leaves(field.dataType)
    }


def _hash(paths):
    return F.sha2(F.concat_ws("\n", paths), 256)


def fingerprint(df, skip=()):
    """Hash of the sorted nested field paths that a row of `df` fills, however deep they lie."""
    found = sorted(_paths(df.schema, skip).items())
    return _hash(F.array_compact(F.array(*[F.when(held, F.lit(path)) for path, held in found])).cast("array<string>"))


def _fitting(df, mappings, skip):
    """(name, condition, turns) of the mappings whose paths are leaves of `df`'s schema."""
    names, leaves = {field.name for field in df.schema} - set(skip), set(_paths(df.schema, skip))
    mark = F.col("fingerprint")
    for name, required, optional, turns in mappings:
        if not set(required) <= leaves:
            continue
        optional = [p for p in optional if p in leaves]
        if not required and not optional:
            continue
        sets = [sorted([*required, *more]) for n in range(len(optional) + 1) for more in combinations(optional, n)]
        fits = F.lit(False)
        for paths in sets:
            fits = fits | (mark == _hash(F.array(*map(F.lit, paths)).cast("array<string>")))
        used = {p.split("[")[0].split(".")[0] for p in [*required, *optional]}
        get = lambda c: F.col(f"`{c}`") if c in used & names else F.lit(None).cast("string")
        yield name, fits, turns(get).cast(TURNS)


def with_layout(df, id_col="conv_id", columns=None, mappings=MAPPINGS):
    """Rows of `df` with fingerprint, layout (null if no mapping fits) and turns.

    `columns` names those that make the layout, by default all but `id_col`; others are ignored.
    """
    own = df.select(id_col, *[f"`{c}`" for c in columns or [c for c in df.columns if c != id_col]])
    marked = own.withColumn("fingerprint", fingerprint(own, (id_col,)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, fits, made in reversed(list(_fitting(own, mappings, (id_col,)))):
        layout = F.when(fits, F.lit(name)).otherwise(layout)
        turns = F.when(fits, made).otherwise(turns)
    return marked.withColumns({"layout": layout, "turns": turns})


def unmapped_rows(df, id_col="conv_id", columns=None, mappings=MAPPINGS):
    return with_layout(df, id_col, columns, mappings).where("layout IS NULL")


def canonical_turns(df, id_col="conv_id", order_col=None, columns=None, mappings=MAPPINGS):
    """A row for each turn: id_col, place, part, role, text, layout."""
    laid = with_layout(df, id_col, columns, mappings).where("layout IS NOT NULL")
    place = F.col(order_col).cast("long") if order_col else F.lit(0).cast("long")
    return laid.select(id_col, place.alias("place"), "layout", F.posexplode("turns").alias("part", "turn_")).select(
        id_col, "place", "part", "turn_.role", "turn_.text", "layout"
    )


def escaped(text):
    """Backslashes doubled, and one put into every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, "#(?=##)", "#\\\\")
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text):
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def format_chats(turns, id_col="conv_id", learned=LEARNED):
    """A row for each conversation: id_col, formatted, spans.

    `spans` are the parts of `formatted` that count for the loss, as first byte, bytes, first code
    point and code points, from 0.
    """
    head = F.concat(F.lit(HEAD), F.replace(escaped(F.col("role")), F.lit(SEP), F.lit(":\\ ")), F.lit(SEP))
    pieces = turns.select(id_col, "place", "part", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy(id_col).orderBy("place", "part", "role", "text")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda size: F.coalesce(F.sum(size("piece")).over(earlier), F.lit(0)) + size("head")
    placed = pieces.select(
        id_col, F.row_number().over(order).alias("n"), "piece",
        F.when(F.col("role") == learned, F.struct(
            so_far(F.octet_length).alias("first_byte"), F.octet_length("body").alias("bytes"),
            so_far(F.length).alias("first_char"), F.length("body").alias("chars"),
        )).alias("span"),
    )
    chats = placed.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("n", "piece", "span"))).alias("all"))
    return chats.select(
        id_col, F.concat_ws("", F.col("all.piece")).alias("formatted"),
        F.filter(F.col("all.span"), lambda s: s.isNotNull()).alias("spans"),
    )


def read_turns(formatted):
    """The turns that a formatted string holds, as an array of role and text."""
    pieces = F.split(formatted, END, -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece):
        role = F.substring_index(piece, SEP, 1)
        return F.struct(
            unescaped(F.substr(role, F.lit(len(HEAD) + 1))).alias("role"),
            unescaped(F.substr(piece, F.length(role) + len(SEP) + 1)).alias("text"),
        )

    return F.transform(pieces, turn)


def loss_text(formatted, spans):
    """All text under the loss mask, unescaped, nothing between its parts."""
    data = F.encode(formatted, "UTF-8")
    parts = F.transform(spans, lambda s: F.decode(
        F.substring(data, (s["first_byte"] + 1).cast("int"), s["bytes"].cast("int")), "UTF-8"))
    return F.concat_ws("", F.transform(parts, unescaped))
