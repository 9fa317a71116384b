"""Row-by-row comparison of a Spark result with SQL's, columns by name and rows in any order."""


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if str(pdf[c].dtype).startswith("datetime"):
            pdf[c] = pdf[c].astype(str)
    return pdf.sort_values(list(pdf.columns), kind="stable", na_position="first").reset_index(drop=True)


def assert_same(ours, theirs):
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    a, b = rows(ours), rows(theirs)
    for c in a.columns:
        x, y = a[c].astype(object).where(a[c].notna(), None), b[c].astype(object).where(b[c].notna(), None)
        wrong = [(i, p, q) for i, (p, q) in enumerate(zip(x, y)) if p != q and not (p is None and q is None)]
        assert not wrong, (c, wrong[:3])
