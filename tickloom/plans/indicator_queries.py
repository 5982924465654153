"""One query per indicator on daily bars: ``ind_<name>``."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import indicators
from tickloom.sources import bars

from .sqlgen import OVER, Query, cum, div, lag, low, mean, roll, top, total, weighted, wma

#: Decimals compared; large sums are compared to fewer, exact fractions (whose sixth decimal may be a tie) to more.
DIGITS = {"mom": 8, "midpoint": 8, "midprice": 8, "ichimoku": 8, "psar": 7, "linear_reg": 4, "linear_reg_value": 4, "obv": 3, "ad_line": 3, "adosc": 3, "force_index": 3, "eom": 0, "pvt": 3, "klinger": 4}


def rounded(frame: DataFrame, digits: int = 6, keep: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    return frame.select(*[F.col(c) if c in keep else F.round(F.col(c), digits).alias(c) for c in frame.columns])


def with_returns(frame: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("ts")
    return frame.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).withColumn("bench", F.col("high") / F.lag("high").over(w) - 1)


#: Indicators that need more than bars: their request on ``with_returns``.
SPECIAL = {
    "rolling_corr": {"a": "ret", "b": "bench"},
    "rolling_beta": {"asset": "ret", "benchmark": "bench"},
    "rolling_sharpe": {},
    "rolling_sortino": {},
}


#: What grows without bound is compared as logarithms: growth indices, and the McGinley recursion, which diverges on prices that jump.
SCALED = {"nvi": F.ln, "pvi": F.ln, "mcginley": lambda x: F.signum(x) * F.ln(1 + F.abs(x))}


def _query(name: str, options: dict | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = bars.bars_daily(spark, sf_dir)
        if name == "hurst":
            return rounded(indicators.hurst(frame))
        if name in SPECIAL:
            frame = with_returns(frame)
        if name in SCALED:
            values = indicators.compute(frame, name)
            return rounded(values.withColumn(name, SCALED[name](F.col(name))))
        return rounded(indicators.compute(frame, (name, SPECIAL.get(name, {}) | (options or {}))), DIGITS.get(name, 6))

    return run


def _sql() -> dict[str, str]:
    q = lambda: Query(bars.DAILY_SQL)
    out: dict[str, str] = {}

    def put(name: str, query: Query, **outputs: str) -> None:
        out[f"ind_{name}"] = query.done(DIGITS.get(name, 6), **outputs)

    # trend
    put("sma", q(), sma=mean("c", 20))
    put("wma", q(), wma=wma("c", 20))
    put("trima", q(), trima=weighted("c", [min(k + 1, 30 - k) / 240 for k in range(30)]))
    put("hma", q().let(x=f"2 * {wma('c', 10)} - {wma('c', 20)}"), hma=wma("x", 4))
    bell = [math.exp(-((k - 6) ** 2) / (2 * 1.5**2)) for k in range(9)]
    put("alma", q(), alma=weighted("c", [b / sum(bell) for b in bell]))
    half = lambda p: f"({top('h', p)} + {low('l', p)}) / 2"
    put("ichimoku", q().let(t=half(9), k=half(26), b=half(52)).let(a="(t + k) / 2"), tenkan="t", kijun="k", senkou_a=lag("a", 25), senkou_b=lag("b", 25))
    last = lambda x, f: f"list_position(list_reverse(list({x}) OVER ({OVER} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)), {f}({x}) OVER ({OVER} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)) - 1"
    since = q().let(sh=last("h", "max"), sl=last("l", "min")).let(up="CASE WHEN i >= 14 THEN 100.0 * (14 - sh) / 14 END", down="CASE WHEN i >= 14 THEN 100.0 * (14 - sl) / 14 END")
    put("aroon", since, aroon_down="down", aroon_up="up")
    put("aroon_osc", since, aroon_osc="up - down")
    put("vortex", q().tr(first=False).let(p=f"abs(h - {lag('l')})", m=f"abs(l - {lag('h')})"), vi_plus=div(total("p", 14), total("tr", 14)), vi_minus=div(total("m", 14), total("tr", 14)))
    put("midpoint", q(), midpoint=f"({top('c', 14)} + {low('c', 14)}) / 2")
    put("midprice", q(), midprice=half(14))
    put("ema", q().ema1("y", "c", 20), ema="y")
    put("dema", q().ema1("y", "c", 20).ema1("z", "y", 20), dema="2 * y - z")
    put("tema", q().ema1("y", "c", 20).ema1("z", "y", 20).ema1("u", "z", 20), tema="3 * y - 3 * z + u")
    put(
        "kama",
        q().let(d=f"abs(c - {lag('c')})").let(path=f"CASE WHEN i >= 10 THEN {total('d', 10)} END").let(r=f"pow({div(f'abs(c - {lag("c", 10)})', 'path', '0.0')} * ({2 / 3 - 2 / 31}) + {2 / 31}, 2)")
        .fold("SELECT symbol, i, c FROM @ WHERE i = 9", y="r.y + t.r * (t.c - r.y)"),
        kama="y",
    )
    put(
        "supertrend",
        q().tr().wilder("a", "tr", 10).let(m="(h + l) / 2", pclose=lag("c"))
        .fold(
            "SELECT symbol, i, m + 3 * a, m - 3 * a, m + 3 * a FROM @ WHERE i = 10",
            line="CASE WHEN t.pclose > r.line THEN greatest(t.m - 3 * t.a, r.lo) ELSE least(t.m + 3 * t.a, r.hi) END",
            lo="CASE WHEN t.pclose > r.line THEN greatest(t.m - 3 * t.a, r.lo) ELSE t.m - 3 * t.a END",
            hi="CASE WHEN t.pclose > r.line THEN t.m + 3 * t.a ELSE least(t.m + 3 * t.a, r.hi) END",
        ),
        supertrend="line",
    )
    chain = q()
    for k in range(6):
        chain.ema(f"e{k + 1}", f"e{k}" if k else "c", 5)
    put("t3", chain, t3="-0.343 * e6 + (3 * 0.49 + 3 * 0.343) * e5 + (-6 * 0.49 - 3 * 0.7 - 3 * 0.343) * e4 + (1 + 3 * 0.7 + 0.343 + 3 * 0.49) * e3")
    put("zlema", q().let(x=f"2 * c - {lag('c', 9)}").ema("y", "x", 20), zlema="y")
    put(
        "vidya",
        q().updown().let(r=f"abs({div(f'{total("up", 9)} - {total("dn", 9)}', f'{total("up", 9)} + {total("dn", 9)}', '0.0')}) * 2 / 15")
        .fold("SELECT symbol, i, c FROM @ WHERE i = 9", y="t.r * t.c + (1 - t.r) * r.y"),
        vidya="y",
    )
    put("mcginley", q().fold("SELECT symbol, i, c FROM @ WHERE i = 0", y="CASE WHEN pow(t.c / r.y, 4) <> 0 THEN r.y + (t.c - r.y) / (6.0 * pow(t.c / r.y, 4)) END"), mcginley="sign(y) * ln(1 + abs(y))")
    # parabolic stop: state (out, stop for the next bar, extreme, speed, side); pl, ph: bounds of this bar and the last (the second bar alone)
    put(
        "psar",
        q().let(pl=f"CASE WHEN i = 1 THEN l ELSE least(l, {lag('l')}) END", ph=f"CASE WHEN i = 1 THEN h ELSE greatest(h, {lag('h')}) END", nh=f"lead(h) OVER ({OVER})", nl=f"lead(l) OVER ({OVER})")
        .fold(
            "SELECT symbol, i, NULL::DOUBLE, CASE WHEN up THEN l ELSE h END, CASE WHEN up THEN nh ELSE nl END, 0.02::DOUBLE, CASE WHEN up THEN 1 ELSE -1 END "
            "FROM (SELECT *, NOT (l - nl > 0 AND nh - h < l - nl) AS up FROM @ WHERE i = 0)",
            value="CASE WHEN r.side = 1 THEN CASE WHEN t.l <= r.stop THEN greatest(r.ep, t.ph) ELSE r.stop END ELSE CASE WHEN t.h >= r.stop THEN least(r.ep, t.pl) ELSE r.stop END END",
            stop="CASE WHEN r.side = 1 THEN CASE WHEN t.l <= r.stop THEN greatest(greatest(r.ep, t.ph) + 0.02 * (t.l - greatest(r.ep, t.ph)), t.ph) "
            "WHEN t.h > r.ep THEN least(r.stop + least(r.af + 0.02, 0.2) * (t.h - r.stop), t.pl) ELSE least(r.stop + r.af * (r.ep - r.stop), t.pl) END "
            "ELSE CASE WHEN t.h >= r.stop THEN least(least(r.ep, t.pl) + 0.02 * (t.h - least(r.ep, t.pl)), t.pl) "
            "WHEN t.l < r.ep THEN greatest(r.stop + least(r.af + 0.02, 0.2) * (t.l - r.stop), t.ph) ELSE greatest(r.stop + r.af * (r.ep - r.stop), t.ph) END END",
            ep="CASE WHEN r.side = 1 THEN CASE WHEN t.l <= r.stop THEN t.l ELSE greatest(r.ep, t.h) END ELSE CASE WHEN t.h >= r.stop THEN t.h ELSE least(r.ep, t.l) END END",
            af="CASE WHEN (r.side = 1 AND t.l <= r.stop) OR (r.side = -1 AND t.h >= r.stop) THEN 0.02 WHEN (r.side = 1 AND t.h > r.ep) OR (r.side = -1 AND t.l < r.ep) THEN least(r.af + 0.02, 0.2) ELSE r.af END",
            side="CASE WHEN (r.side = 1 AND t.l <= r.stop) OR (r.side = -1 AND t.h >= r.stop) THEN -r.side ELSE r.side END",
        ),
        psar="value",
    )
    put("trix", q().ema("e1", "c", 30).ema("e2", "e1", 30).ema("e3", "e2", 30).let(p=lag("e3")), trix=f"{div('e3 - p', 'p', '0.0')} * 100")
    put("mass_index", q().let(x="h - l").ema("e1", "x", 9).ema("e2", "e1", 9).let(r=div("e1", "e2")), mass_index=total("r", 25))
    place = lambda x: {"value": f"CASE WHEN t.hi > t.lo THEN (t.{x} - t.lo) / (t.hi - t.lo) * 100 ELSE r.value END"}
    first = "SELECT t.symbol, t.i, CASE WHEN hi > lo THEN ({x} - lo) / (hi - lo) * 100 ELSE 0.0 END, CASE WHEN hi > lo THEN ({x} - lo) / (hi - lo) * 100 ELSE 0.0 END FROM @ t JOIN (SELECT symbol, min(i) AS k FROM @ WHERE lo IS NOT NULL GROUP BY symbol) d ON d.symbol = t.symbol AND d.k = t.i"
    stc = q().ema("e1", "c", 23).ema("e2", "c", 50).let(m="e1 - e2").let(lo=low("m", 10), hi=top("m", 10))
    stc.fold(first.format(x="m"), value=place("m")["value"], pf=f"r.pf + 0.5 * ({place('m')['value']} - r.pf)")
    stc.parts.append(f"s{stc.at + 1} AS MATERIALIZED (SELECT symbol, ts, i, pf AS m, lo2 AS lo, hi2 AS hi FROM (SELECT *, {low('pf', 10)} AS lo2, {top('pf', 10)} AS hi2 FROM s{stc.at}))")
    stc.at += 1
    stc.fold(first.format(x="m"), value=place("m")["value"], pf2=f"r.pf2 + 0.5 * ({place('m')['value']} - r.pf2)")
    put("stc", stc, stc="pf2")

    # momentum
    put("rsi", q().rsi("y", "c", 14), rsi="y")
    put("macd", q().ema1("a", "c", 12).ema1("b", "c", 26).let(m="a - b").ema1("g", "m", 9), macd="m", signal="g", histogram="m - g")
    put(
        "stochastic",
        q().let(lo=low("l", 14), r=f"{top('h', 14)} - {low('l', 14)}").let(k="CASE WHEN r > 1e-15 THEN (c - lo) / r * 100 WHEN r IS NOT NULL THEN 50.0 END").let(k0="coalesce(k, 50.0)"),
        k="k", d=f"CASE WHEN i >= 13 THEN {mean('k0', 3)} END",
    )
    put("williams_r", q().let(hi=top("h", 14)).let(r=f"hi - {low('l', 14)}"), williams_r="CASE WHEN r > 1e-15 THEN (hi - c) / r * -100 WHEN r IS NOT NULL THEN -50.0 END")
    put(
        "cci",
        q().let(x="(h + l + c) / 3").let(m=mean("x", 20), xs=f"list(x) OVER ({OVER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)").let(d="CASE WHEN m IS NOT NULL THEN 0.015 * list_avg(list_transform(xs, lambda z: abs(z - m))) END"),
        cci="CASE WHEN d > 1e-15 THEN (x - m) / d WHEN d IS NOT NULL THEN 0.0 END",
    )
    put("roc", q().let(p=lag("c", 12)), roc=f"{div('c - p', 'p', '0.0')} * 100")
    put("momentum", q().let(p=lag("c", 20)), momentum="CASE WHEN abs(p) > 1e-15 THEN (c / p - 1) * 100 WHEN p IS NOT NULL THEN 0.0 END")
    put("mom", q(), mom=f"c - {lag('c', 10)}")
    put("rocp", q().let(p=lag("c", 10)), rocp=div("c - p", "p", "0.0"))
    put("rocr", q().let(p=lag("c", 10)), rocr=div("c", "p", "0.0"))
    dm = lambda: q().tr(first=False).let(hd=f"h - {lag('h')}", ld=f"{lag('l')} - l").let(pd="CASE WHEN hd > ld AND hd > 0 THEN hd WHEN hd IS NOT NULL THEN 0.0 END", md="CASE WHEN ld > hd AND ld > 0 THEN ld WHEN hd IS NOT NULL THEN 0.0 END")
    put("adx", dm().wilder("a", "pd", 14).wilder("b", "md", 14).wilder("t", "tr", 14).let(p=f"{div('a', 't', '0.0')} * 100", m=f"{div('b', 't', '0.0')} * 100").let(x=div("abs(p - m) * 100", "p + m", "0.0")).wilder("y", "x", 14), adx="y")
    put("mfi", q().let(x="(h + l + c) / 3").let(d=f"x - {lag('x')}").let(p="CASE WHEN d > 0 THEN x * v WHEN d IS NOT NULL THEN 0.0 END", n="CASE WHEN d < 0 THEN x * v WHEN d IS NOT NULL THEN 0.0 END"), mfi=f"100 - 100 / (1 + {total('p', 14)} / greatest({total('n', 14)}, CASE WHEN {total('n', 14)} IS NOT NULL THEN 1e-15 END))")
    slow = q().let(lo=low("l", 5), hi=top("h", 5)).let(raw=f"{div('c - lo', 'hi - lo', '0.0')} * 100").let(k=mean("raw", 3)).let(d=mean("k", 3))
    put("stochastic_slow", slow, slow_k="CASE WHEN d IS NOT NULL THEN k END", slow_d="d")
    put("stoch_rsi", q().rsi("y", "c", 14).let(lo=low("y", 5), hi=top("y", 5)).let(k=f"{div('y - lo', 'hi - lo', '0.0')} * 100").let(d=mean("k", 3)), fast_k="CASE WHEN d IS NOT NULL THEN k END", fast_d="d")
    put("cmo", q().updown().let(a=total("up", 14), b=total("dn", 14)), cmo=f"{div('a - b', 'a + b', '0.0')} * 100")
    uo = q().let(pc=lag("c")).let(bp="CASE WHEN pc IS NOT NULL THEN c - least(l, pc) END", rg="CASE WHEN pc IS NOT NULL THEN greatest(h, pc) - least(l, pc) END")
    put("ultimate_oscillator", uo, ultimate_oscillator="CASE WHEN i >= 28 THEN 100 * (" + " + ".join(f"{w} * {div(total('bp', p), total('rg', p), '0.0')}" for w, p in ((4, 7), (2, 14), (1, 28))) + ") / 7 END")
    put("awesome_oscillator", q().let(x="(h + l) / 2"), awesome_oscillator=f"{mean('x', 5)} - {mean('x', 34)}")
    put("apo", q().ema("a", "c", 12).ema("b", "c", 26), apo="a - b")
    put("ppo", q().ema("a", "c", 12).ema("b", "c", 26), ppo=f"{div('a - b', 'b', '0.0')} * 100")
    kst = q().let(**{f"p{n}": lag("c", n) for n in (10, 15, 20, 30)}).let(**{f"r{n}": f"{div(f'c - p{n}', f'p{n}', '0.0')} * 100" for n in (10, 15, 20, 30)})
    kst.let(k=f"{mean('r10', 10)} + 2 * {mean('r15', 10)} + 3 * {mean('r20', 10)} + 4 * {mean('r30', 15)}")
    put("kst", kst, kst="k", signal=mean("k", 9))
    tsi = q().let(m=f"c - {lag('c')}").let(a="abs(m)").ema("m1", "m", 25).ema("m2", "m1", 13).ema("a1", "a", 25).ema("a2", "a1", 13).let(t=f"{div('m2', 'a2', '0.0')} * 100").ema("g", "t", 13)
    put("tsi", tsi, tsi="t", signal="g")
    crsi = q().let(pc=lag("c")).let(sg="coalesce(sign(c - pc), 0)", r1=div("c - pc", "pc", "0.0"))
    crsi.fold("SELECT symbol, i, 0.0::DOUBLE FROM @ WHERE i = 0", streak="CASE WHEN r.streak * t.sg <= 0 THEN t.sg ELSE r.streak + t.sg END")
    crsi.rsi("ra", "c", 3).rsi("rb", "streak", 2).let(past=f"list(r1) OVER ({OVER} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)")
    put("connors_rsi", crsi, connors_rsi="CASE WHEN i > 100 THEN (ra + rb + len(list_filter(past, lambda z: z < r1)) * 1.0) / 3 END")
    fisher = q().let(x="(h + l) / 2").let(lo=low("x", 9), hi=top("x", 9)).let(p="CASE WHEN hi - lo > 1e-15 THEN (x - lo) / (hi - lo) - 0.5 WHEN hi IS NOT NULL THEN 0.0 END")
    step = "0.66 * t.p + 0.67 * r.fv"
    bound = f"CASE WHEN {step} > 0.99 THEN 0.999 WHEN {step} < -0.99 THEN -0.999 ELSE {step} END"
    fisher.fold("SELECT symbol, 7, 0.0::DOUBLE, 0.0::DOUBLE FROM @ WHERE i = 8", fv=bound, ff=f"0.5 * ln((1 + ({bound})) / (1 - ({bound}))) + 0.5 * r.ff").let(f="CASE WHEN i >= 8 THEN ff END")
    put("fisher_transform", fisher, fisher="f", trigger=lag("f"))
    put("coppock", q().let(a=lag("c", 14), b=lag("c", 11)).let(x=f"({div('c - a', 'a', '0.0')} + {div('c - b', 'b', '0.0')}) * 100"), coppock=wma("x", 10))
    put("dpo", q(), dpo=f"{lag('c', 11)} - {mean('c', 20)}")
    four = [1 / 6, 2 / 6, 2 / 6, 1 / 6]
    rvgi = q().let(a="c - o", b="h - l").let(x=weighted("a", four), y=weighted("b", four)).let(r=div(total("x", 10), total("y", 10)))
    put("rvgi", rvgi, rvgi="r", signal=weighted("r", four))
    put("elder_ray", q().ema("e", "c", 13), bull_power="h - e", bear_power="l - e")
    wt = q().let(x="(h + l + c) / 3").ema("e", "x", 10).let(f="x - e", g="abs(x - e)").ema("d", "g", 10).let(ci=div("f", "0.015 * d")).ema("w", "ci", 21)
    put("wavetrend", wt, wt1="w", wt2=mean("w", 4))
    put("bop", q(), bop=div("c - o", "h - l", "0.0"))
    dmi = dm()
    for x in ("pd", "md", "tr"):
        dmi.fold(f"SELECT symbol, 13, sum({x}) FROM @ WHERE i BETWEEN 1 AND 13 GROUP BY symbol", **{f"s_{x}": f"r.s_{x} - r.s_{x} / 14 + t.{x}"})
    dmi.let(trs="CASE WHEN i >= 14 THEN s_tr END").let(p=div("100 * s_pd", "trs", "0.0"), m=div("100 * s_md", "trs", "0.0")).let(x=div("100 * abs(p - m)", "p + m", "0.0")).wilder("a", "x", 14)
    put("dmi", dmi, plus_di="p", minus_di="m", dx="x", adx="a", adxr=f"(a + {lag('a', 13)}) / 2", plus_dm="s_pd", minus_dm="s_md")

    # volatility
    put("atr", q().tr().wilder("a", "tr", 14), atr="a")
    put("natr", q().tr().wilder("a", "tr", 14), natr=f"{div('a', 'c')} * 100")
    put("keltner", q().ema1("m", "c", 20).tr().wilder("a", "tr", 10), upper="m + 1.5 * a", middle="m", lower="m - 1.5 * a")
    put("bollinger", q().let(m=mean("c", 20), s=roll("stddev_pop", "c", 20)), upper="m + 2 * s", middle="m", lower="m - 2 * s")
    put("donchian", q(), upper=top("h", 20), lower=low("l", 20))
    put("realized_vol", q().let(x="ln(greatest(c, 1e-15))").let(r=f"x - {lag('x')}"), realized_vol=f"{roll('stddev_samp', 'r', 20)} * sqrt(252)")
    gk = q().let(a="ln(greatest(h / greatest(l, 1e-15), 1e-15))", b="ln(greatest(c / greatest(o, 1e-15), 1e-15))").let(g=f"0.5 * a * a - {2 * math.log(2) - 1!r} * b * b").let(m=mean("g", 20))
    put("garman_klass", gk, garman_klass="CASE WHEN m >= 0 THEN sqrt(m) * sqrt(252) END")
    put("chaikin_volatility", q().let(x="h - l").ema("e", "x", 10).let(p=lag("e", 10)), chaikin_volatility=f"{div('e - p', 'p')} * 100")
    put("ulcer_index", q().let(p=top("c", 14)).let(d=f"pow({div('c - p', 'p')} * 100, 2)"), ulcer_index=f"sqrt({mean('d', 14)})")
    put("choppiness", q().tr(first=False).let(r=div(total("tr", 14), f"{top('h', 14)} - {low('l', 14)}")), choppiness="CASE WHEN r > 0 THEN 100 * log10(r) / log10(14) END")
    put("parkinson", q().let(x="pow(ln(h / l), 2)"), parkinson=f"sqrt({mean('x', 20)} / (4 * ln(2))) * sqrt(252)")
    rs = "ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o)"
    put("rogers_satchell", q().let(x=rs).let(m=mean("x", 20)), rogers_satchell="CASE WHEN m IS NOT NULL THEN sqrt(greatest(m, 0)) * sqrt(252) END")
    k = 0.34 / (1.34 + 21 / 19)
    yz = q().let(pc=lag("c")).let(g="ln(o / pc)", d="CASE WHEN pc IS NOT NULL THEN ln(c / o) END", x=f"CASE WHEN pc IS NOT NULL THEN {rs} END")
    yz.let(t=f"{roll('var_samp', 'g', 20)} + {k!r} * {roll('var_samp', 'd', 20)} + {1 - k!r} * {mean('x', 20)}")
    put("yang_zhang", yz, yang_zhang="CASE WHEN t IS NOT NULL THEN sqrt(greatest(t, 0)) * sqrt(252) END")

    # volume
    put("vwap", q(), vwap=div(cum("sum", "(h + l + c) / 3 * v"), cum("sum", "v")))
    put("obv", q().let(x=f"coalesce(sign(c - {lag('c')}) * v, 0.0)"), obv=cum("sum", "x"))
    clv = div("(c - l) - (h - c)", "h - l", "0.0") + " * v"
    put("cmf", q().let(x=clv), cmf=div(total("x", 20), total("v", 20), "0.0"))
    put("volume_zscore", q().let(s=roll("stddev_samp", "v", 20), m=mean("v", 20)), volume_zscore="CASE WHEN s > 1e-15 THEN (v - m) / s WHEN s IS NOT NULL THEN 0.0 END")
    put("vwma", q().let(x="c * v"), vwma=div(total("x", 20), total("v", 20)))
    put("ad_line", q().let(x=clv), ad_line=cum("sum", "x"))
    put("adosc", q().let(x=clv).let(y=cum("sum", "x")).ema1("a", "y", 3).ema1("b", "y", 10), adosc="CASE WHEN i >= 9 THEN a - b END")
    put("force_index", q().let(x=f"(c - {lag('c')}) * v").ema("y", "x", 13), force_index="y")
    put("eom", q().let(x="(h + l) / 2").let(y=div(f"(x - {lag('x')}) * (h - l) * 1e8", "v")), eom=mean("y", 14))
    put("klinger", q().let(x="(h + l + c) / 3").let(y=f"sign(x - {lag('x')}) * v").ema("a", "y", 34).ema("b", "y", 55).let(k="a - b").ema("g", "k", 13), klinger="k", signal="g")
    for name, sign in (("nvi", "<"), ("pvi", ">")):
        put(name, q().let(pc=lag("c"), pv=lag("v")).fold("SELECT symbol, i, 1000.0::DOUBLE FROM @ WHERE i = 0", y=f"CASE WHEN t.v {sign} t.pv AND abs(t.pc) > 1e-15 THEN r.y * t.c / t.pc ELSE r.y END"), **{name: "ln(y)"})
    put("pvt", q().let(pc=lag("c")).let(x=f"coalesce({div('c - pc', 'pc', '0.0')} * v, 0.0)"), pvt=cum("sum", "x"))
    put("pvo", q().ema("a", "v", 12).ema("b", "v", 26).let(p=f"{div('a - b', 'b')} * 100").ema("g", "p", 9), pvo="p", signal="g", histogram="p - g")

    # statistics
    put("zscore", q().let(s=roll("stddev_samp", "c", 60), m=mean("c", 60)), zscore="CASE WHEN s > 1e-15 THEN (c - m) / s WHEN s IS NOT NULL THEN 0.0 END")
    w60 = f"OVER ({OVER} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    pair = lambda: q().let(x=f"c / {lag('c')} - 1", y=f"h / {lag('h')} - 1").let(n=f"count(x * y) {w60}", cv=f"covar_samp(x, y) {w60}", vx=f"var_samp(x) {w60}", vy=f"var_samp(y) {w60}")
    put("rolling_corr", pair(), rolling_corr=f"CASE WHEN n < 60 THEN NULL WHEN sqrt(vx) <= 1e-15 OR sqrt(vy) <= 1e-15 THEN 0.0 ELSE cv / (sqrt(vx) * sqrt(vy)) END")
    put("rolling_beta", pair(), rolling_beta=f"CASE WHEN n < 60 THEN NULL ELSE {div('cv', 'vy', '0.0')} END")
    line = lambda p: q().let(m=mean("c", p), vp=roll("var_pop", "c", p), ic=f"CASE WHEN i >= {p - 1} THEN sum(c * i) OVER ({OVER} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW) END").let(xy=f"ic - (i - {(p - 1) / 2}) * m * {p}").let(b=f"xy / {p * (p * p - 1) / 12}").let(a=f"m - b * {(p - 1) / 2}", r2=f"CASE WHEN vp * {p} > 1e-15 THEN xy * xy / ({p * (p * p - 1) / 12} * vp * {p}) WHEN vp IS NOT NULL THEN 0.0 END")
    put("linear_reg", line(20), slope="b", r_squared="r2", intercept="a", forecast="a + b * 20")
    put("linear_reg_value", line(14), linear_reg_value="a + b * 13")
    put("linear_reg_angle", line(14), linear_reg_angle="degrees(atan(b))")
    put("efficiency_ratio", q().let(d=f"abs(c - {lag('c')})"), efficiency_ratio=div(f"abs(c - {lag('c', 10)})", total("d", 10)))
    ret = lambda: q().let(x=f"c / {lag('c')} - 1")
    put("rolling_sharpe", ret(), rolling_sharpe=f"{div(mean('x', 63), roll('stddev_samp', 'x', 63))} * sqrt(252)")
    put("rolling_sortino", ret().let(d="pow(least(x, 0), 2)").let(d2="CASE WHEN x IS NOT NULL THEN d END"), rolling_sortino=f"{div(mean('x', 63), f'sqrt({mean("d2", 63)})')} * sqrt(252)")
    out["ind_hurst"] = f"""
WITH b AS ({bars.DAILY_SQL}),
r AS (SELECT symbol, i - 2 AS i, r FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, ln(greatest(close, 1e-15)) - lag(ln(greatest(close, 1e-15))) OVER (PARTITION BY symbol ORDER BY ts) AS r FROM b) WHERE i > 1),
n AS (SELECT symbol, count(*) AS n FROM r GROUP BY symbol),
g AS (SELECT r.symbol, lag, i // lag AS block, i, r FROM r JOIN n USING (symbol), range(2, 101) AS l(lag) WHERE lag <= n // 2 AND (i // lag + 1) * lag <= n),
d AS (SELECT *, r - avg(r) OVER (PARTITION BY symbol, lag, block) AS e FROM g),
y AS (SELECT *, sum(e) OVER (PARTITION BY symbol, lag, block ORDER BY i) AS y FROM d),
k AS (SELECT symbol, lag, block, max(y) - min(y) AS rg, stddev_samp(r) AS sd FROM y GROUP BY ALL HAVING stddev_samp(r) > 1e-15),
m AS (SELECT symbol, lag, ln(avg(rg / sd)) AS rs FROM k GROUP BY ALL)
SELECT n.symbol, round(coalesce(CASE WHEN count(rs) >= 2 THEN regr_slope(rs, ln(lag)) END, 0.5), 6) AS hurst FROM n LEFT JOIN m USING (symbol) GROUP BY n.symbol
"""
    return out


QUERIES = {f"ind_{n}": _query(n) for n in indicators.NAMES}
SQL = _sql()
