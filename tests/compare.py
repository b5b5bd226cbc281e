"""Tables as sorted rows, columns by name, floats rounded."""


def rows(table):
    names = sorted(table.column_names)
    columns = [[round(v, 9) if isinstance(v, float) else v for v in table[c].to_pylist()] for c in names]
    return names, sorted(map(repr, zip(*columns, strict=True)))
