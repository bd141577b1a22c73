"""What several test modules share; ``conftest`` is not imported by name."""

from datetime import datetime

T0 = datetime(2024, 1, 1, 8, 0, 0)  # a Monday


def rows_of(df, *columns):
    columns = columns or sorted(df.columns)
    return sorted(tuple(r) for r in df.select(*columns).collect())


def plain_edit_distance(a, b, same=None):
    """The whole table, cell by cell; ``same(i, j)`` is the cost of keeping equal elements."""
    far = len(a) + len(b)
    table = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            equal = a[i - 1] == b[j - 1]
            k = max((k for k in range(1, i) if a[k - 1] == b[j - 1]), default=0)
            m = max((m for m in range(1, j) if b[m - 1] == a[i - 1]), default=0)
            table[i + 1][j + 1] = min(
                table[i][j] + ((same(i - 1, j - 1) if same else 0) if equal else 1),
                table[i + 1][j] + 1,
                table[i][j + 1] + 1,
                table[k][m] + (i - k) + (j - m) - 1,
            )
    return table[len(a) + 1][len(b) + 1]
