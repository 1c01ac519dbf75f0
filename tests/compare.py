"""Order-insensitive comparison of results, exact to the last bit."""

from __future__ import annotations

KINDS = {
    "tinyint": "int",
    "smallint": "int",
    "integer": "int",
    "int": "int",
    "bigint": "bigint",
    "double": "double",
    "varchar": "string",
    "string": "string",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp",
    "timestamp_ntz": "timestamp",
}


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def spark_result(frame):
    kinds = {f.name: KINDS[f.dataType.simpleString()] for f in frame.schema.fields}
    return kinds, canonical(frame.columns, frame.collect())


def duck_result(connection, sql):
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    types = connection.execute(f"DESCRIBE {sql}").fetchall()
    return {t[0]: KINDS.get(t[1].lower(), t[1]) for t in types}, canonical(columns, rows)
