"""Whether two frames hold the same rows in any order."""

import pandas as pd


def plain(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if str(out[c].dtype).startswith("datetime"):
            out[c] = out[c].astype("datetime64[us]").astype(str)
        elif out[c].dtype == object:
            out[c] = out[c].map(lambda v: None if v is None or v is pd.NaT else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def same(one: pd.DataFrame, two: pd.DataFrame) -> None:
    a, b = plain(one), plain(two)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)
