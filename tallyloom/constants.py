"""Class orders, thresholds and word lists of the label engine."""

from __future__ import annotations

#: Classes from most to least severe (fixed values); ties go to the first.
ABUSE_ORDER = ["성학대", "신체학대", "정서학대", "방임"]
VALENCE_ORDER = ["부정", "평범", "긍정"]
ABUSE_LABEL_EN = {"방임": "Neglect", "정서학대": "Emotional abuse", "신체학대": "Physical abuse", "성학대": "Sexual abuse"}
NO_ABUSE = "해당없음"

#: Spellings of ground-truth labels and their standard forms (fixed values).
GT_CANON = {"신체적학대": "신체학대", "정서적학대": "정서학대", "성적학대": "성학대", "성폭력": "성학대", "성폭행": "성학대", "유기": "방임"}

#: Crisis levels that decide the first valence (fixed values).
CRISIS_NEGATIVE = ["응급", "위기아동", "학대의심", "상담필요"]
CRISIS_POSITIVE = "정상군"
CRISIS_NEUTRAL = "관찰필요"

#: Stop words of the tokeniser (fixed values).
STOPWORDS = [
    "자다", "모르다", "아니다", "않다", "그렇다", "싶다", "나다",
    "이다", "하다", "되다", "같다", "있다", "없다",
    "좀", "조금", "많이", "그냥", "막", "또", "근데",
    "이제", "그래서", "그러면", "그리고",
    "때문", "때문에", "거", "것",
    "사람", "애들", "애기", "어른",
    "공부", "시험", "시간",
    "거기", "여기", "저기", "이거", "저거",
    "하루", "맨날", "항상", "가끔", "자주", "매일",
    "정도", "수준", "상태", "상황", "요즘",
    "0점", "1점", "2점", "3점", "4점", "5점", "6점", "7점", "8점", "9점",
    "정상군", "위기", "위기아동", "상담필요", "관찰필요",
]

#: (smallest p1, smallest p2, largest gap) of the bridge configurations (fixed values).
BRIDGE_CONFIGS = {"B0": (0.40, 0.25, 0.20), "loose": (0.30, 0.20, 0.25), "strict": (0.45, 0.30, 0.20)}
#: Thresholds and sizes of the analyses (fixed values).
BRIDGE_MIN_COUNT = 5
BRIDGE_MIN_LOGODDS = 1.0
DELTA_GRID = [0.5, 0.8, 1.0, 1.2, 1.5]
REFERENCE_DELTA = 1.0
Z_MIN = 1.96
CHI2_TOP = 200
ALPHA = 0.01
MIN_DOCS, MIN_TOKENS_VALENCE, MIN_TOKENS_ABUSE = 5, 10, 8
MAIN_THRESHOLD, SUB_THRESHOLD = 6, 4
