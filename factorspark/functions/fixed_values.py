"""Fixed values.

Names, codes, thresholds and word lists that have to be exactly these for
results to be right.
"""

# Factor scoring
FACTOR_VERSION = "flow_momentum_quality_v001"
EVALUATED_FACTORS = [
    "mom_20", "mom_60", "ma_strength", "flow_5d", "flow_20d", "flow_persistence",
    "winner_rate", "winner_rate_change_5d", "vol_20", "max_drawdown_60",
    "avg_amount_20", "total_score",
]
ANALYSIS_FACTORS = [
    "mom_20", "mom_60", "ma_strength", "flow_5d", "flow_20d", "winner_rate",
    "vol_20", "max_drawdown_60", "avg_amount_20", "momentum_score", "flow_score",
    "chip_score", "risk_score", "liquidity_score", "total_score",
]
FACTOR_COLUMNS = [
    "symbol", "trade_date", "name", "market_segment", "industry",
    "mom_20", "mom_60", "ma_strength", "macd_signal",
    "flow_5d", "flow_20d", "flow_persistence",
    "winner_rate", "winner_rate_change_5d", "winner_rate_change_20d",
    "vol_20", "max_drawdown_60", "downside_vol_20",
    "avg_amount_20", "turnover_stability",
    "momentum_score", "flow_score", "chip_score", "risk_score", "liquidity_score",
    "total_score", "tradable_flag", "exclusion_reason", "factor_version",
]
FACTOR_RUN_FAMILIES = ["flow_momentum_quality", "candidate_002"]

# exclusions
ST_NAME_PATTERN = r"\*?ST"
MIN_LISTING_DAYS = 120
MIN_AVG_AMOUNT = 50000

# Trading year and default benchmark
TRADING_DAYS_PER_YEAR = 252
DEFAULT_BENCHMARK = "000852.SH"

# Broad indexes (code, role)
BROAD_INDEXES = [
    ("000300.SH", "大盘核心资产"),
    ("000905.SH", "中盘"),
    ("000852.SH", "小盘"),
    ("399006.SZ", "成长"),
    ("000688.SH", "硬科技成长"),
    ("899050.BJ", "北交所小微高波动"),
]
BENCHMARK_SYMBOLS = ["000852.SH", "000300.SH", "000905.SH", "399006.SZ", "000688.SH", "899050.BJ"]
GROWTH_INDEXES = ["399006.SZ", "000688.SH"]
SMALL_CAP_INDEXES = ["000852.SH", "899050.BJ"]

# Industry -> theme
INDUSTRY_THEME = [
    ("电子", "科技成长"), ("计算机", "科技成长"), ("通信", "科技成长"), ("传媒", "科技成长"),
    ("电力设备", "高端制造"), ("机械设备", "高端制造"), ("国防军工", "高端制造"), ("汽车", "高端制造"),
    ("煤炭", "资源周期"), ("有色金属", "资源周期"), ("钢铁", "资源周期"), ("石油石化", "资源周期"),
    ("基础化工", "资源周期"),
    ("银行", "金融地产"), ("非银金融", "金融地产"), ("房地产", "金融地产"), ("建筑材料", "金融地产"),
    ("建筑装饰", "金融地产"),
    ("食品饮料", "消费医药"), ("商贸零售", "消费医药"), ("社会服务", "消费医药"), ("美容护理", "消费医药"),
    ("医药生物", "消费医药"),
    ("公用事业", "防御高股息"), ("交通运输", "防御高股息"), ("环保", "防御高股息"),
]
OTHER_THEME = "其他"
GROWTH_THEME = "科技成长"

# Candidate labels
REASON_LABELS = [("momentum_score", "价格趋势"), ("flow_score", "资金活跃度"), ("liquidity_score", "流动性")]
REASON_FALLBACK = "综合研究证据"

# Exchange and board -> segment code, display name
MARKET_SEGMENTS = [
    ("SH", "主板", "sh_main", "上证主板"),
    ("SH", "科创板", "star", "科创板"),
    ("SZ", "主板", "sz_main", "深市主板"),
    ("SZ", "创业板", "chinext", "创业板"),
]
BEIJING_SEGMENT = ("BJ", "北交所", "bj", "北交所")
UNKNOWN_SEGMENT = ("unknown", "未知")

# Provenance marks of the flow and chip providers
FLOW_METHOD = "tushare_moneyflow_dc"
CHIP_METHOD = "tushare_cyq_perf"
CALENDAR_ID = "cn_a_share"
CLASSIFICATION_SYSTEM = "SW2021"

# Fields each provider batch has to carry
EXPECTED_FIELDS = {
    "stock_basic": ["ts_code", "symbol", "name", "market", "list_date"],
    "trade_cal": ["exchange", "cal_date", "is_open"],
    "daily": ["ts_code", "trade_date", "open", "high", "low", "close", "vol", "amount"],
    "adj_factor": ["ts_code", "trade_date", "adj_factor"],
    "index_daily": ["ts_code", "trade_date", "open", "high", "low", "close"],
    "daily_basic": ["ts_code", "trade_date", "turnover_rate"],
    "stk_limit": ["ts_code", "trade_date", "up_limit", "down_limit"],
    "suspend_d": ["ts_code", "trade_date", "suspend_type"],
    "moneyflow_dc": ["ts_code", "trade_date", "net_amount", "net_amount_rate"],
    "moneyflow_ths": ["ts_code", "trade_date", "net_d5_amount"],
    "cyq_perf": ["ts_code", "trade_date", "winner_rate"],
    "index_classify": ["index_code", "industry_name", "level"],
    "sw_daily": ["ts_code", "trade_date", "close", "pct_change"],
}

# Provider error keywords
RATE_LIMIT_WORDS = ["每分钟", "频次", "频率", "频率超限", "访问接口", "访问该接口", "最多访问", "超过", "limit", "rate"]
PERMISSION_WORDS = ["权限", "没有权限", "积分", "2002", "permission"]

# Wording that a published payload must not carry
PROHIBITED_TERMS = ["买入", "卖出", "加仓", "减仓", "目标价", "仓位", "保证收益", "必涨", "buy", "sell", "target price"]
SENSITIVE_TERMS = ["tushare_token", "provider token", "raw_payload", "raw provider"]
LOCAL_PATH_PATTERN = r"[a-zA-Z]:[\\/]"

# Payload versions
MARKET_STATUS_VERSION = "market_status_v001"
CANDIDATE_POOL_VERSION = "candidate_pool_v001"
DAILY_BUNDLE_VERSION = "daily_publish_bundle_v001"
STOCK_ANALYSIS_VERSION = "stock_app_stock_analysis_v001"
NO_RISK_NOTE = "No blocking risk flag in the selected factor run."
WEAK_RISK_NOTE = "Recent volatility or drawdown score is weak."
NO_EVIDENCE_NOTE = "No current factor evidence is available for this symbol."

# Texts of the signal strategy
RANKING_REASON = "net_amount_rate>0; MACD golden cross; winner_rate="
DETAILED_REASON = "main_net_inflow_rate>0; MACD golden cross; close_profit_ratio>80; exclude ST/*ST; close_profit_ratio="
RANKING_COLUMNS = [
    "rank", "symbol", "name", "signal_date", "recommend_trade_date", "close",
    "main_net_inflow_rate", "close_profit_ratio", "return_20d", "macd_golden_cross", "reason",
]
PASS_COLUMNS = [
    "factor_rank", "symbol", "name", "signal_date", "recommend_trade_date", "close",
    "main_net_inflow_rate", "pass_main_net_inflow_rate", "macd_golden_cross", "pass_macd_golden_cross",
    "close_profit_ratio", "pass_close_profit_ratio", "return_20d", "pass_exclude_st", "factor_pass",
    "factor_value", "reason",
]

# Dataset -> column of the price table that proves a date is covered
PRICE_COVERAGE_FIELDS = {
    "adj_factor": "adj_factor", "daily_basic": "turnover_rate",
    "stk_limit": "limit_up", "suspend_d": "is_suspended",
}
