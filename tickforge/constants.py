"""Fixed values. They must equal the published ones for results to match."""

# Placement grid and costs
SL_MULTS = [0.8, 1.2, 1.8, 2.6, 3.4, 4.5]
TP_RATIOS = [1.3, 1.8, 2.5, 3.0, 4.0, 5.5, 7.0]
MIN_SL_FLOOR = 0.30
SPREAD = 0.20
SPREAD_POINTS = 20.0
MAX_BARS_M1 = 60
MAX_BARS_M5 = 36
EXTENSION = 4

# Regime names
REGIMES = [
    "STRONG_UP", "UP", "DOWN", "STRONG_DOWN",
    "RANGE_TIGHT", "RANGE_WIDE", "HIGH_VOL", "QUIET_LOW_VOL",
]

# Central-bank decision days (month, day), statement at 19:00 UTC
FOMC_DAYS = {
    2024: [(1, 31), (3, 20), (5, 1), (6, 12), (7, 31), (9, 18), (11, 7), (12, 18)],
    2026: [(1, 28), (3, 18), (4, 29), (6, 17), (7, 29), (9, 16), (10, 28), (12, 9)],
}

# Columns never offered to a model
RAW_PRICE_COLS = [
    "open", "high", "low", "close", "atr_14", "tick_volume", "real_volume",
    "macd", "macd_sig", "macd_hist", "body", "upper_wick", "lower_wick", "vol_atr_ratio",
]
HTF_COLS = [
    "h1_trend", "d1_trend", "m15_trend",
    "m1_h1_vol_ratio", "m1_d1_vol_ratio", "m15_m1_vol_ratio",
    "h1_pos", "d1_pos", "m15_pos",
    "dist_h1_hi", "dist_h1_lo", "dist_m15_hi", "dist_m15_lo",
    "htf_align", "m15_align",
]
PLACEMENT_COLS = [
    "sl_dist_buy", "tp_dist_buy", "sl_dist_sell", "tp_dist_sell",
    "sl_atr_buy", "sl_atr_sell", "rr_buy", "rr_sell", "direction",
]

# Seeds of the model ensembles
SEEDS = [42, 7, 2026]
