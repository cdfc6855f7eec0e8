"""Word lists and patterns whose exact values decide results."""

# Research methods and the patterns that name them.
METHODS = {
    "DID": r"\bDID\b|difference[ -]in[ -]differences|双重差分|双重差分法",
    "事件研究": r"event.study|事件研究",
    "中介分析": r"mediat(?:ion|ing)|中介",
    "工具变量": r"instrumental.variable|工具变量",
    "门槛模型": r"threshold.model|门槛",
    "固定效应": r"fixed.effect|固定效应",
}

# Terms looked for in titles.
CHINESE_TERMS = "碳市场 碳交易 碳排放 绿色创新 绿色金融 绿色信贷 绿色专利 企业创新 融资约束 数字化 环境规制 产业结构 政策试点 同群效应 技术创新 全要素生产率".split()

# Words of titles that are no keywords.
STOPWORDS = "the and for with from that this are its using how does what under between through green study evidence effect impact corporate innovation carbon market markets china research analysis based policy firms enterprise enterprises an of in on to a as by at is or be their can do we which have not".split()

# Ranks of claim strength, weakest first.
STRENGTHS = ["insufficient", "preliminary", "mixed", "associational", "causal_cautious"]

# Statements that deny, doubt, ask or postpone and are taken out before the search.
DENIALS = "不能解释为因果|不代表因果关系|不构成因果证据|无法确认因果关系|不能据此推断因果|不能推断因果|不支持因果解释|并非因果证据|does not (?:establish|imply|demonstrate) causality|cannot (?:infer|establish) causality"
NOT_CLAIMED = [
    "(?i)" + DENIALS,
    r"(?:尚不能|不能解释为|不能|不足以|不支持|无法识别|无法|不作|不据此|不宜|避免|不解释为|并非|不构成|不主张|不宣称|不在于|不用于|不形成|不推断|不作为)(?:(?!否认|排除|不|但|却|然而)[^，。；！？,;!?\n]){0,30}因果(?:关系|解释|证据|效应|结论|机制|推断)?",
    r"(?:是否存在|是否具有|是否构成|待检验(?:的)?|有待检验(?:的)?)(?:(?!证明|导致|证实|表明|但|却|然而)[^，。；！？,;!?\n]){0,30}因果(?:关系|效应|机制)?",
    r"(?:待|具备|获得|补齐|满足)(?:(?!但|却|然而)[^，。；！？,;!?\n]){0,60}后再(?:考虑|开展)(?:(?!但|却|然而)[^，。；！？,;!?\n]){0,30}因果(?:识别|研究|分析|设计)*",
]

# Titles in brackets, or in quotes behind a cue.
TITLE_SPANS = r"《[^》\n]*》|(?:标题(?:为|是)?|文献(?:为|是)?|论文(?:为|是)?|数据集(?:为|是)?|(?:发布|发表)的)\s*[:：]?\s*(?:“[^”\n]*”|「[^」\n]*」|\"[^\"\n]*\")"

# Words that claim a cause.
CHINESE_CAUSAL = "促进|导致|造成|驱动|引致|因果"
ENGLISH_CAUSAL = r"\b(?:caus(?:e[sd]?|ing|al(?:ity)?)|promot(?:e[sd]?|ing)|induc(?:e[sd]?|ing)|driv(?:e[sn]?|ing)|led to|leads? to|effect of)\b"

# Phrases with numeral characters that are no quantities.
NO_QUANTITY = "零膨胀 零值 二元 两类 两者 单一 首次 进一步 一方面 另一方面 另一个 另一项 另一 其一 之一 一致 一般 统一 不一定 一定程度 一并 逐一 一旦 唯一 同一 分别 分布 分析 分组 分样本".split()

# Quantities written in words.
CHINESE_QUANTITY = r"[零〇一二两三四五六七八九十百千万亿半壹贰叁肆伍陆柒捌玖拾佰仟数几]+(?:点[零〇一二两三四五六七八九]+)?\s*(?:家|名|个|条|行|次|期|年|月|日|天|倍|成|项|类|组|种|份|篇|例|人|元|岁|分|秒|小时|数|%|％)|翻倍|成倍"
ENGLISH_QUANTITY = r"\b(?:zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|half|quarter|third|double|triple)\b"

# Sections that describe methods, where wording is not limited.
METHOD_SECTIONS = ["techniques", "experiments", "methods"]

# What keeps a claim from a stronger verdict.
NOT_REPRODUCED = "主模型失败或独立复算未确认一致"
FEW_SAME_SIGN = "指定稳健性同向比例未达门槛，失败检查计入分母"
PERMUTATION = "置换检验未通过或未完成"
PRETREND = "前趋势检验未通过或不可估计"
DIRECTION = "主系数方向或显著性不支持预期"
NOT_ASSIGNED = "处理变量为同群/暴露变量，非真实分配"

# What is reported.
UNKNOWN_PLACEHOLDER, BARE_NUMBER, TOO_STRONG = "存在未知数字占位符", "所有数字须使用给定占位符", "存在超出结论上限的措辞"
