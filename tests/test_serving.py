"""Serving profile vs a direct pandas statement of its rules on a history slice."""
import math

import pandas as pd
import pytest

from veldt import config as C
from veldt.operators import serving as SV
from veldt.plans import panels

SF = "/root/testdata/sf0.001"


def expected(hist: pd.DataFrame, target) -> dict:
    """Features for ``target`` from rows dated [target-90, target] only."""
    h = hist[(hist.day >= target - pd.Timedelta(days=90)) & (hist.day <= target)].sort_values("day")
    precip = h.precipitation.fillna(0.0)
    temp = h.temp_max
    nd = h.ndvi.ffill(limit=7)
    fire = h.firms_count.fillna(0)
    month = precip[h.day.dt.month == target.month]
    out = {
        "rain_7d": precip.tail(7).sum(), "rain_30d": precip.tail(30).sum(), "rain_60d": precip.tail(60).sum(),
        "temp_max_7d": temp.tail(7).mean(), "temp_max_30d": temp.tail(30).mean(),
        "hot_days_30d": float((temp > 35).tail(30).sum()),
        "ndvi": 0.0 if pd.isna(nd.iloc[-1]) else nd.iloc[-1],
        "ndvi_90d_avg": nd.tail(90).mean(),
        "fire_30d": float(fire.tail(30).sum()), "fire_90d": float(fire.tail(90).sum()),
    }
    out["rain_deficit_30d"] = out["rain_30d"] - month.mean() * 30
    lag = nd.shift(30).iloc[-1] if len(nd) > 30 else float("nan")
    out["ndvi_30d_lag"] = out["ndvi"] if pd.isna(lag) else lag
    out["ndvi_deviation"] = out["ndvi"] - out["ndvi_90d_avg"]
    fires = h.day[fire > 0]
    out["days_since_fire"] = float(min((target - fires.max()).days, 365)) if len(fires) else 365.0
    return out


@pytest.mark.parametrize("entity", ["NATION_3", "NATION_17"])
def test_serving_profile_matches_rules(spark, entity):
    raw = panels.raw_panel(spark, SF).where(f"entity = '{entity}'")
    pdf = raw.select("day", "precipitation", "temp_max", "ndvi", "firms_count").toPandas()
    pdf["day"] = pd.to_datetime(pdf["day"])
    got = SV.serve_vector(SV.serve_features(raw)).toPandas()
    got["day"] = pd.to_datetime(got["day"])
    got = got.set_index("day")
    days = sorted(pdf.day)
    for target in [days[5], days[40], days[120], days[700], days[-1]]:
        exp = expected(pdf, target)
        row = got.loc[target]
        for k, v in exp.items():
            g = row[k]
            if v is None or (isinstance(v, float) and math.isnan(v)):
                assert g is None or pd.isna(g), (target, k, g)
            else:
                assert g == pytest.approx(v, rel=1e-9, abs=1e-8), (target, k, g, v)
