"""Word lists of the news analytics."""

# Words that negate the hit after them, weights of words, words of sectors and of impact levels.
NEGATIONS = ["不", "不会", "没有", "未", "非", "无", "否认", "难以", "不再", "并非"]

POSITIVE = {
    "利好": 0.6, "上涨": 0.5, "大涨": 0.7, "涨停": 0.8, "暴涨": 0.8,
    "突破": 0.4, "新高": 0.6, "反弹": 0.4, "回升": 0.3, "走强": 0.4,
    "增长": 0.4, "盈利": 0.5, "超预期": 0.6, "景气": 0.4, "繁荣": 0.5,
    "降息": 0.5, "降准": 0.5, "宽松": 0.4, "刺激": 0.4, "扶持": 0.4,
    "补贴": 0.4, "减税": 0.5, "利润增长": 0.6, "业绩预增": 0.7,
    "订单": 0.3, "签约": 0.3, "合作": 0.3, "并购": 0.3, "重组": 0.4,
    "回购": 0.4, "增持": 0.5, "举牌": 0.5, "北向资金流入": 0.5,
    "放量": 0.3, "资金流入": 0.4, "机构看好": 0.4, "评级上调": 0.5,
    "IPO": 0.3, "上市": 0.3, "融资": 0.3, "定增": 0.3,
    "技术突破": 0.5, "自主可控": 0.4, "国产替代": 0.5, "量产": 0.4,
    "经济复苏": 0.5, "就业改善": 0.4, "出口增长": 0.4, "消费回暖": 0.4,
    "政策支持": 0.4, "产业升级": 0.4, "数字化转型": 0.3,
}

NEGATIVE = {
    "利空": -0.6, "下跌": -0.5, "大跌": -0.7, "跌停": -0.8, "暴跌": -0.8,
    "破位": -0.5, "新低": -0.6, "回调": -0.3, "走弱": -0.4, "下行": -0.3,
    "亏损": -0.5, "下滑": -0.4, "不及预期": -0.6, "萧条": -0.5,
    "加息": -0.4, "收紧": -0.4, "监管": -0.3, "处罚": -0.5, "罚款": -0.5,
    "退市": -0.8, "爆雷": -0.8, "违规": -0.5, "造假": -0.7,
    "减持": -0.5, "抛售": -0.6, "清仓": -0.6, "北向资金流出": -0.5,
    "缩量": -0.3, "资金流出": -0.4, "评级下调": -0.5, "风险": -0.3,
    "战争": -0.5, "制裁": -0.5, "贸易摩擦": -0.4, "通胀": -0.3,
    "债务": -0.3, "违约": -0.6, "破产": -0.7, "裁员": -0.4,
    "立案调查": -0.7, "内幕交易": -0.6, "操纵市场": -0.6, "信披违规": -0.5,
    "经济衰退": -0.6, "滞胀": -0.5, "资本外流": -0.5, "汇率贬值": -0.4,
    "产能过剩": -0.4, "库存积压": -0.3, "需求萎缩": -0.5,
}

SECTORS = {
    "银行": ["银行", "信贷", "存款", "贷款", "LPR"],
    "房地产": ["房地产", "楼市", "房价", "地产", "住房", "土地"],
    "科技": ["芯片", "半导体", "AI", "人工智能", "算力", "大模型", "机器人"],
    "新能源": ["新能源", "光伏", "锂电", "储能", "风电", "氢能", "充电桩"],
    "汽车": ["汽车", "新能源车", "电动车", "智能驾驶", "自动驾驶"],
    "医药": ["医药", "医疗", "创新药", "疫苗", "生物医药", "中药"],
    "消费": ["消费", "白酒", "食品", "零售", "电商", "旅游"],
    "军工": ["军工", "国防", "航空", "航天", "导弹", "军事"],
    "有色金属": ["黄金", "白银", "铜", "铝", "锂", "稀土", "有色"],
    "石油化工": ["石油", "原油", "天然气", "化工", "煤炭"],
    "农业": ["农业", "粮食", "猪肉", "养殖", "种业"],
    "传媒": ["传媒", "游戏", "影视", "短视频", "直播"],
    "宏观经济": ["GDP", "CPI", "PPI", "PMI", "央行", "货币政策", "财政"],
    "半导体": ["晶圆", "封测", "EDA", "光刻", "制程", "芯片设计"],
    "信创": ["信创", "国产化", "操作系统", "数据库", "中间件", "办公软件"],
    "数据要素": ["数据要素", "数据交易", "数据确权", "数字经济", "数据资产"],
    "低空经济": ["低空经济", "eVTOL", "无人机", "飞行汽车", "通用航空"],
}

HIGH_IMPACT = ["重磅", "突发", "紧急", "历史性", "首次", "全面", "大幅", "暴涨", "暴跌", "涨停", "跌停", "爆雷", "退市"]
MEDIUM_IMPACT = ["超预期", "不及预期", "调整", "变化", "新政", "改革", "增长", "下滑", "回升", "回调"]

# Tags of formulas, by words in them.
FORMULA_TAGS = {
    "量价关系": ["correlation", "covariance"],
    "横截面排序": ["rank(", "ts_rank"],
    "动量反转": ["delta", "delay", "returns"],
    "波动率": ["std", "variance"],
    "流动性": ["volume", "adv"],
    "成交均价偏离": ["vwap"],
    "K线结构": ["open", "high", "low", "close"],
    "趋势平滑": ["mean", "sma", "decaylinear"],
}
NO_TAG = "复合信号"
