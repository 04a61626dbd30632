"""Deeply nested records as flat tables with parent links.

Method: one higher-order SQL projection per source. Nested ``transform`` calls attach the keys and positions
of the ancestors, ``flatten`` joins the arrays of a level and one ``inline`` per target table emits its rows.
Nothing is shuffled, so hot keys and long lists don't matter.

JSON payloads are taken apart level by level with ``from_json`` as lists or maps of texts, which keeps the
order in which keys are written (a parsed VARIANT would sort them).

Defined results:

* null, empty and invalid payloads (also those followed by other text) yield no rows;
* a payload that is itself a JSON string holding JSON is read as the JSON it holds;
* null lists are empty; null list elements count for positions and yield no row;
* an object in place of a list is a map from keys to children if all its values are objects, else one child;
* wrappers around records are opened at any depth; lists found beside each other count as one list;
* entrances of segments, at any depth, are entrances of their road;
* a bare text in place of a child object is the child's key;
* keys are returned as stored; null or blank ones are null;
* repeated rows are kept, extra columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_fresh = count()

LIST, MAP = "'array<string>'", "'map<string,string>'"
#: JSON as standard defines it: no single quotes.
STRICT = "map('allowSingleQuotes', 'false')"
#: Keys that a road or card has itself; an object with none of them holds records by ID.
RECORD_KEYS = ("roadId", "id", "entrances", "segments", "sources", "name", "classification")
#: Keys under which an envelope holds its records, then those that lead deeper.
LISTS, WRAPPERS = ("roads", "cards"), ("data", "result", "payload", "body", "response")
#: What the records of these lists are.
KINDS = ("nagano_entrances", "karte")


def _let(value: str, body) -> str:
    """SQL of ``body`` of a variable that is bound to ``value``."""
    v = f"v{next(_fresh)}"
    return f"get(transform(array({value}), {v} -> {body(v)}), 0)"


def _starts(x: str, sign: str) -> str:
    return f"startswith(ltrim({x}), '{sign}')"


def _nonblank(x: str) -> str:
    return f"CASE WHEN {x} RLIKE '(?U)\\\\S' THEN {x} END"


def _decode(x: str) -> str:
    """The one JSON value that ``x`` holds, as text; null if it holds none or more."""
    return _let(f"from_json(concat('[', {x}, ']'), {LIST}, {STRICT})", lambda v: f"CASE WHEN size({v}) = 1 THEN {v}[0] END")


def _has(m: str, keys) -> str:
    return "(" + " OR ".join(f"map_contains_key({m}, '{k}')" for k in keys) + ")"


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _holds_lists(x: str) -> str:
    """Whether a JSON text as ``from_json`` writes it has a list of records somewhere."""
    return "(" + " OR ".join(f"contains({x}, '\"{n}\":')" for n in LISTS) + ")"


def _item(name: str, key: str, value: str, is_open: str) -> str:
    return f"named_struct('l', CAST({name} AS STRING), 'k', CAST({key} AS STRING), 'v', {value}, 'o', {is_open})"


def _opened(item: str) -> str:
    """What an open item holds, in reading order; an item that is no envelope comes back closed."""
    closed = f"array({_item(f'{item}.l', f'{item}.k', f'{item}.v', 'false')})"

    def of_map(m: str) -> str:
        e = f"e{next(_fresh)}"
        deeper = f"{_starts(f'{e}.v', '{')} AND {_holds_lists(f'{e}.v')}"
        inner = f"filter({_entries(m)}, {e} -> {e}.k IN ({_quoted((*LISTS, *WRAPPERS))}) OR ({deeper}))"
        inner = f"filter({inner}, {e} -> {_starts(f'{e}.v', '{')} OR {_starts(f'{e}.v', '[')})"
        items = _let(inner, lambda found: f"CASE WHEN size({found}) = 0 AND NOT {_has(m, LISTS)} THEN {closed} ELSE transform({found}, {e} -> {_item(f'CASE WHEN {e}.k IN ({_quoted(LISTS)}) THEN {e}.k ELSE {item}.l END', 'NULL', f'{e}.v', 'true')}) END")
        return f"CASE WHEN {m} IS NULL OR ({_has(m, RECORD_KEYS)} AND NOT {_has(m, LISTS)}) THEN {closed} ELSE {items} END"

    v = f"v{next(_fresh)}"
    of_list = f"transform(from_json({item}.v, {LIST}), {v} -> {_item(f'{item}.l', 'NULL', v, f'{v} IS NOT NULL')})"
    mapped = _let(f"from_json({item}.v, {MAP})", of_map)
    return f"CASE WHEN NOT {item}.o THEN array({item}) WHEN {_starts(f'{item}.v', '[')} AND {_holds_lists(f'{item}.v')} THEN coalesce({of_list}, {closed}) WHEN {_starts(f'{item}.v', '{')} THEN {mapped} ELSE {closed} END"


def _repeated(items: str, step, is_open, most: str) -> str:
    """``items`` with ``step`` for each, as often as there are open ones; ``most`` bounds how often that can be.

    Rounds in which nothing is open cost no more than a test of the flag.
    """
    state, i, x, n = (f"{v}{next(_fresh)}" for v in "sixn")
    opened = f"flatten(transform({state}.items, {x} -> {step(x)}))"
    after = _let(opened, lambda found: f"named_struct('go', exists({found}, {i} -> {is_open(i)}), 'items', {found})")
    zero = _let(items, lambda found: f"named_struct('go', exists({found}, {i} -> {is_open(i)}), 'items', {found})")
    return f"aggregate(sequence(0, {most}), {zero}, ({state}, {n}) -> CASE WHEN {state}.go THEN {after} ELSE {state} END, {state} -> {state}.items)"


def _list_items(x: str) -> str:
    v = f"v{next(_fresh)}"
    return f"transform(from_json({x}, {LIST}), {v} -> named_struct('k', CAST(NULL AS STRING), 'v', {v}))"


def _entries(m: str) -> str:
    e = f"e{next(_fresh)}"
    return f"transform(map_entries({m}), {e} -> named_struct('k', {e}.key, 'v', {e}.value))"


NONE = "CAST(array() AS ARRAY<STRUCT<k: STRING, v: STRING>>)"


def _one(x: str) -> str:
    return f"array(named_struct('k', CAST(NULL AS STRING), 'v', {x}))"


def _records(x: str) -> str:
    """Roads or cards of a container, in reading order, with the key each is listed under."""
    as_map = _let(f"from_json({x}, {MAP})", lambda m: f"CASE WHEN {_has(m, RECORD_KEYS)} THEN {_one(x)} ELSE {_entries(m)} END")
    return f"coalesce(CASE WHEN {x} IS NULL THEN {_one(x)} WHEN {_starts(x, '[')} THEN {_list_items(x)} WHEN {_starts(x, '{')} THEN {as_map} END, {NONE})"


def _children(x: str) -> str:
    """Children of a list, a map by key, a wrapped list, a single object or a bare text."""

    def of_map(m: str) -> str:
        v = f"v{next(_fresh)}"
        keyed = f"size({m}) > 0 AND forall(map_values({m}), {v} -> {v} IS NULL OR {_starts(v, '{')})"
        return f"CASE WHEN map_contains_key({m}, 'items') THEN coalesce({_list_items(m + '[' + chr(39) + 'items' + chr(39) + ']')}, {NONE}) WHEN {keyed} THEN {_entries(m)} WHEN size({m}) = 0 THEN {NONE} ELSE {_one(x)} END"

    return f"coalesce(CASE WHEN {x} IS NULL THEN {NONE} WHEN {_starts(x, '[')} THEN {_list_items(x)} WHEN {_starts(x, '{')} THEN {_let(f'from_json({x}, {MAP})', of_map)} ELSE {_one(x)} END, {NONE})"


def _entrances_of(m: str, text: str) -> str:
    """Entrances of a road, those of its segments and of segments within them included, in reading order."""
    e, c, p = (f"{v}{next(_fresh)}" for v in "ecp")
    parts = lambda entries: f"filter({entries}, {p} -> {p}.k IN ('entrances', 'segments'))"

    def step(x: str) -> str:
        inner = _let(f"from_json({c}.v, {MAP})", lambda sm: f"coalesce({parts(_entries(sm))}, {NONE})")
        return f"CASE WHEN {x}.k = 'segments' THEN flatten(transform({_children(f'{x}.v')}, {c} -> {inner})) ELSE array({x}) END"

    marks = "\"segments\":"
    depth = f"CAST((length({text}) - length(replace({text}, '{marks}', ''))) / {len(marks)} AS INT)"
    found = f"CASE WHEN map_contains_key({m}, 'segments') THEN {_repeated(parts(_entries(m)), step, lambda x: f'{x}.k = {chr(39)}segments{chr(39)}', depth)} ELSE {parts(_entries(m))} END"
    return f"flatten(transform({found}, {e} -> {_children(f'{e}.v')}))"


def _record_fields(record: str) -> str:
    """Struct of a record: its own key, its map of fields, its kind if its list tells, and its children."""
    named = " ".join(f"WHEN '{name}' THEN '{kind}'" for name, kind in zip(LISTS, KINDS, strict=True))
    body = lambda m: (
        f"named_struct('record_key', coalesce({_nonblank(f'{m}[{chr(39)}roadId{chr(39)}]')}, {_nonblank(f'{m}[{chr(39)}id{chr(39)}]')}, {_nonblank(f'{record}.k')}), "
        f"'fields', {m}, 'kind', CASE {record}.l {named} END, "
        f"'entrances', {_entrances_of(m, f'{record}.v')}, 'sources', {_children(f'{m}[{chr(39)}sources{chr(39)}]')})"
    )
    return _let(f"from_json({record}.v, {MAP})", body)


def raw_record_tree(raw: DataFrame) -> DataFrame:
    """Payloads as an array of records, each with its key, kind, fields and children as (key, text).

    Envelopes are opened until none is left, however deep; the lists found beside each other are put together in
    reading order.
    """
    df = raw.select(F.col("raw_no").alias("record_no"), "kind", F.expr(_decode(_decode("payload"))).alias("doc"))
    start = f"CASE WHEN doc IS NULL THEN CAST(array() AS ARRAY<STRUCT<l: STRING, k: STRING, v: STRING, o: BOOLEAN>>) ELSE array({_item('NULL', 'NULL', 'doc', 'true')}) END"
    # Each round opens one level, and each level begins with a sign of its own.
    depth = "length(doc) - length(translate(doc, '{[', ''))"
    df = df.withColumn("items", F.expr(_repeated(start, _opened, lambda x: f"{x}.o", f"coalesce({depth}, 0)")))
    i, r = f"i{next(_fresh)}", f"r{next(_fresh)}"
    records = f"flatten(transform(items, {i} -> transform({_records(f'{i}.v')}, {r} -> named_struct('l', {i}.l, 'k', {r}.k, 'v', {r}.v))))"
    return df.withColumn("records", F.expr(records)).select("record_no", "kind", F.expr(f"transform(records, {r} -> {_record_fields(r)})").alias("records"))


ENTRANCE_FIELDS = ("lat", "lon", "status", "pointType", "accessClass", "surface", "navEnabled", "description", "source", "sourceUrl", "checkedOn")
SOURCE_FIELDS = ("title", "note")


def _child_rows(child: str, key_sql, fields) -> str:
    """Struct of a child's key and fields; a null child is null."""

    def body(m: str) -> str:
        cols = ", ".join(f"'{f}', {m}['{f}']" for f in fields)
        return f"named_struct('child_key', {key_sql(m)}, {cols})"

    return _let(f"CASE WHEN {_starts(child + '.v', '{')} THEN from_json({child}.v, {MAP}) END", body)


def _entrance_key(child: str):
    bare = f"CASE WHEN NOT {_starts(child + '.v', '{')} THEN {_nonblank(child + '.v')} END"
    return lambda m: f"CASE WHEN {child}.v IS NOT NULL THEN coalesce({_nonblank(m + '[' + chr(39) + 'id' + chr(39) + ']')}, {bare}, {_nonblank(child + '.k')}) END"


def _source_key(child: str):
    bare = f"CASE WHEN NOT {_starts(child + '.v', '{')} THEN {_nonblank(child + '.v')} END"

    def key(m: str) -> str:
        url = f"{m}['url']"
        nested = _let(f"from_json({url}, {MAP})", lambda n: f"coalesce({n}['href'], {n}['url'])")
        return f"CASE WHEN {child}.v IS NOT NULL THEN coalesce({_nonblank(f'CASE WHEN {_starts(url, chr(123))} THEN {nested} ELSE {url} END')}, {_nonblank(f'{m}[{chr(39)}href{chr(39)}]')}, {bare}) END"

    return key


def _inline_children(tree: DataFrame, list_name: str, key, fields) -> DataFrame:
    r, c, i, j = (f"{x}{next(_fresh)}" for x in "rcij")
    row = _let(_child_rows(c, key(c), fields), lambda s: "named_struct('road_pos', {i} + 1, 'child_pos', {j} + 1, 'parent_key', {r}.record_key, 'child_key', {s}.child_key, {rest})".format(i=i, j=j, r=r, s=s, rest=", ".join(f"'{f}', {s}.{f}" for f in fields)))
    nested = f"flatten(transform(records, ({r}, {i}) -> transform(coalesce({r}.{list_name}, {NONE}), ({c}, {j}) -> {row})))"
    return tree.select("record_no", F.expr(f"inline({nested})"))


def raw_roads(raw: DataFrame) -> DataFrame:
    """Roads and cards of the payloads: ``(record_no, kind, road_pos, record_key, name, classification)``."""
    return raw_record_tree(raw).select(
        "record_no",
        F.expr("inline(transform(records, (r, i) -> named_struct('road_pos', i + 1, 'kind', coalesce(r.kind, kind), 'record_key', r.record_key, 'name', r.fields['name'], 'classification', r.fields['classification'], 'n_entrances', size(r.entrances), 'n_sources', size(r.sources))))"),
    )


def raw_entrances(raw: DataFrame) -> DataFrame:
    """Entrances of the payloads with the position and key of their road."""
    return _inline_children(raw_record_tree(raw), "entrances", _entrance_key, ENTRANCE_FIELDS)


def raw_sources(raw: DataFrame) -> DataFrame:
    """Sources of the payloads with the position and key of their card."""
    return _inline_children(raw_record_tree(raw), "sources", _source_key, SOURCE_FIELDS)


def table_entrances(entrances: DataFrame) -> DataFrame:
    """Entrances of the typed table with the position and key of their road; null elements are null rows."""
    fields = ", ".join(f"'{f}', CAST(e.{f} AS STRING)" for f in ENTRANCE_FIELDS)
    row = f"named_struct('road_pos', 1, 'child_pos', i + 1, 'parent_key', roadId, 'child_key', {_nonblank('e.id')}, {fields})"
    return entrances.select("record_no", F.expr(f"inline(transform(entrances, (e, i) -> {row}))"))


def table_sources(cards: DataFrame) -> DataFrame:
    """Sources of the typed table with the position and key of their card."""
    row = f"named_struct('road_pos', 1, 'child_pos', i + 1, 'parent_key', id, 'child_key', {_nonblank('s.url')}, 'title', s.title, 'note', s.note)"
    return cards.select(F.col("card_row").alias("record_no"), F.expr(f"inline(transform(sources, (s, i) -> {row}))"))


def all_roads(entrances: DataFrame, raw: DataFrame) -> DataFrame:
    """One row per road: parent table of the entrances."""
    typed = entrances.select(F.lit("nagano_entrances").alias("src"), "record_no", F.lit(1).alias("road_pos"), F.col("roadId").alias("road_key"), "classification", F.coalesce(F.size("entrances"), F.lit(0)).alias("n_children"))
    typed = typed.withColumn("n_children", F.greatest("n_children", F.lit(0)))
    other = raw_roads(raw).filter("kind = 'nagano_entrances'").select(F.lit("raw_records").alias("src"), "record_no", "road_pos", F.col("record_key").alias("road_key"), "classification", F.col("n_entrances").alias("n_children"))
    return typed.unionByName(other)


def all_cards(cards: DataFrame, raw: DataFrame) -> DataFrame:
    """One row per card: parent table of the sources."""
    typed = cards.select(F.lit("karte").alias("src"), F.col("card_row").alias("record_no"), F.lit(1).alias("road_pos"), F.col("id").alias("card_key"), "name", F.greatest(F.coalesce(F.size("sources"), F.lit(0)), F.lit(0)).alias("n_children"))
    other = raw_roads(raw).filter("kind = 'karte'").select(F.lit("raw_records").alias("src"), "record_no", "road_pos", F.col("record_key").alias("card_key"), "name", F.col("n_sources").alias("n_children"))
    return typed.unionByName(other)


def all_entrances(entrances: DataFrame, raw: DataFrame) -> DataFrame:
    """One row per entrance of all sources, null elements included."""
    typed = table_entrances(entrances).withColumn("src", F.lit("nagano_entrances"))
    return typed.unionByName(raw_entrances(raw).withColumn("src", F.lit("raw_records")))


def all_sources(cards: DataFrame, raw: DataFrame) -> DataFrame:
    """One row per source of all cards, null elements included."""
    typed = table_sources(cards).withColumn("src", F.lit("karte"))
    return typed.unionByName(raw_sources(raw).withColumn("src", F.lit("raw_records")))


def keyed_children(entrances: DataFrame, cards: DataFrame, raw: DataFrame) -> DataFrame:
    """Entrances and sources that have a key, each under its record, road and position."""
    cols = ("src", "record_no", "road_pos", "child_pos", "child_kind", "child_key")
    a = all_entrances(entrances, raw).withColumn("child_kind", F.lit("entrance"))
    b = all_sources(cards, raw).withColumn("child_kind", F.lit("source"))
    return a.select(*cols).unionByName(b.select(*cols)).filter(F.col("child_key").isNotNull())
