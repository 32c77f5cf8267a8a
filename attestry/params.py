"""Thresholds and fixed values.

Every number and word list below has to equal the behaviour being reproduced, so they are stated here once,
plainly, and passed around as ``Params``.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """All thresholds; ``parity=True`` switches the documented defects back on."""

    parity: bool = False
    script: str = "any"
    # chunking
    chunk_tokens: int = 2048
    chunk_overlap: int = 256
    # retrieval
    w_bm25: float = 0.4
    w_vector: float = 0.4
    w_rerank: float = 0.2
    rrf_k: int = 60
    topk_bm25: int = 30
    topk_vector: int = 30
    topk_rerank: int = 10
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    rrf_floor: float = 0.006
    kw_floor: float = 0.15
    kw_strong: float = 0.30
    fallback_rows: int = 2
    # audit
    jaccard_min: float = 0.25
    sentence_min: float = 0.60
    confidence_min: float = 0.40
    align_match: int = 55
    align_snap: int = 86
    cite_map_min: float = 0.2
    cite_line_min: float = 0.3
    # dialogue
    context_boost: float = 0.15
    topic_margin: float = 0.03
    topic_confidence: float = 0.2
    topic_min_score: float = 0.1
    topic_overlap: float = 0.4
    # logs
    slow_ms: float = 5000.0
    high_memory_mb: float = 500.0
    high_tokens: int = 2000


# --------------------------------------------------------------------------------------------------------
# Word lists, patterns and tables that results depend on.
# --------------------------------------------------------------------------------------------------------

# Index stop words: particles, endings, auxiliaries.
STOP_WORDS = (
    "은", "는", "이", "가", "을", "를", "에", "에서", "의", "와", "과", "도", "만", "로", "으로",
    "부터", "까지", "보다", "처럼", "같이", "마저", "조차", "에게", "한테", "께",
    "다", "요", "죠", "네", "군", "구나",
    "하다", "되다", "이다", "아니다", "있다", "없다",
)

# Suffixes removed by the particle strip.
PARTICLE_SUFFIXES = (
    "은", "는", "이", "가", "을", "를", "에", "의", "도", "만", "와", "과", "로", "서",
    "부터", "까지", "에서", "에게", "한테", "으로", "라고",
)

# Content-word heuristic.
VERB_ENDINGS = (
    "하다", "되다", "이다", "하는", "되는", "한다", "된다", "하고", "되고", "이고", "하여", "되어", "이어", "하니", "되니",
)
FUNCTION_WORDS_3 = ("그리고", "하지만", "그러나", "또한", "그런데", "따라서", "그래서")
NOUN_FINALS = ("촌", "관", "장", "과", "단", "원", "실", "부", "국", "청", "소", "처", "회", "사", "인")

# Query normaliser.
QUERY_INTERROGATIVES = ("무엇", "뭐", "어떤", "어떻게", "왜", "언제", "어디", "누가", "누구")
QUERY_COPULAS = ("입니까", "입니다", "인가요", "인가", "일까요", "일까", "예요", "이에요")
QUERY_PARTICLES = ("은", "는", "이", "가", "을", "를", "에", "에서", "으로", "로", "와", "과")

# Abbreviation dictionary.
ABBREVIATIONS = {"예규": "예산규정", "훈령": "훈련령", "고시": "고시문", "공고": "공고문", "지침": "지침서"}

# Currency units, value in won.
CURRENCY_UNITS = {
    "십만": 100_000, "백만": 1_000_000, "천만": 10_000_000, "억": 100_000_000,
    "십억": 1_000_000_000, "백억": 10_000_000_000, "천억": 100_000_000_000, "조": 1_000_000_000_000,
}

# Full-width punctuation and its half-width form, position by position.
FULL_WIDTH = "。、「」『』（）［］｛｝：；！？～－＿／＼＠＃＄％＆＊＋＝＜＞｜"
HALF_WIDTH = ".,\"\"\"\"()[]{}:;!?~-_/\\@#$%&*+=<>|"

# Korean numerals.
NUMERAL_VALUES = {
    "영": 0, "일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "칠": 7, "팔": 8, "구": 9,
    "십": 10, "백": 100, "천": 1000, "만": 10_000, "억": 100_000_000, "조": 1_000_000_000_000,
}
NUMERAL_PATTERN = "[일이삼사오육칠팔구십백천만억조]+"

# Units accepted after a number.
QUANTITY_UNITS = (
    "원", "명", "개", "건", "년", "월", "일", "시간", "분", "초",
    "미터", "킬로미터", "그램", "킬로그램", "리터", "평", "톤",
)

# Legal references: law, regulation, article.
LEGAL_PATTERNS = (
    r"[가-힣]+법\s*제?\s*\d+\s*조",
    r"[가-힣]+(?:규정|규칙|령)\s*제?\s*\d+\s*조",
    r"제\s*\d+\s*조(?:\s*제\s*\d+\s*항)?",
)

# Personal data: kind -> (pattern, mask). Order of masking is decided by the operator.
PII_PATTERNS = {
    "phone": (r"\d{2,3}[-.\s]?\d{3,4}[-.\s]?\d{4}", "[전화번호]"),
    "rrn": (r"\d{6}[-\s]?\d{7}", "[주민등록번호]"),
    "email": (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[이메일]"),
    "card": (r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}", "[카드번호]"),
}
PII_ORDER_PARITY = ("phone", "rrn", "email", "card")
PII_ORDER = ("card", "rrn", "phone", "email")

# Forbidden input.
FORBIDDEN_PATTERNS = (r"<script[^>]*>.*?</script>", r"javascript:", r"on\w+\s*=", r"<iframe")
MAX_QUERY_CHARS = 2000
MAX_FILE_BYTES = 10 * 1024 * 1024
FILE_SUFFIXES = ("pdf", "hwp")
DOC_SUFFIX_PATTERN = r"\.(pdf|hwp|txt)$"

# Phrases that mark an answer as generic.
GENERIC_PHRASES = (
    "죄송합니다", "찾을 수 없습니다", "모르겠습니다", "정보가 없습니다", "알 수 없습니다", "근거가 부족합니다",
    "문서에 없습니다", "확인할 수 없습니다", "판단하기 어렵습니다",
)

# Entity filters for conversation memory.
ENTITY_ENDINGS = ("하다", "되다", "이다", "한다", "된다", "합니다")
ENTITY_QUESTION_PARTS = ("어떻", "무엇", "어디", "언제")
META_KEYWORDS = ("요약", "정리", "간단히", "짧게", "다시", "설명")

# Layout extraction.
BULLET = "○"
MAIN_BOUNDARY_OFFSET = -12.0
BOX_SYMBOLS = "󰏅󰎨│┃┌┐└┘├┤┬┴┼─━"
RULE_LINE_PATTERN = r"^[│┃┌┐└┘├┤┬┴┼─━\s]+$"
PAGE_NUMBER_PATTERN = r"^\s*-?\s*\d{1,3}\s*-?\s*$"
HEADER_PATTERN = (
    r"(구청장\s*(지시|훈시|보고)\s*사항|일\s*련|처\s*리|지\s*시|기\s*한|주\s*관|관\s*련|담\s*당|부서(?!\s*$)|처리기한|처리주관"
    r"|부서기한관|주관부서|관련부서|일련|번호|구분|사항|계속|훈\s*시|보\s*고)"
)
HEADER_TERMS = ("일련", "처리", "지시", "기한", "주관", "관련")
NOISE_PATTERN = r"(처리|기한|주관|관련|담당|번호|구분|계속)"
DATE_PATTERN = r"(2,?0\d{2})\.\s*(\d{1,2})\.\s*(\d{1,2})\.?"
DATE_REMOVALS = (DATE_PATTERN, r"2,?0\d{2}\.", r"\b\d{1,2}\.\s*\d{1,2}\.")
CRITICAL_KEYWORDS = ("구청장", "지시", "사항", "처리", "기한")
ORG_SUFFIXES = ("과", "소", "국", "실", "관", "센터", "사업소", "팀", "단")

# Unit dictionary for layout labels.
DEPARTMENTS = (
    "총무과", "기획예산과", "기획조정실", "감사실", "홍보담당관", "행정지원과", "행정지원국", "안전도시국", "미래성장국",
    "복지환경국", "경제일자리과", "일자리경제과", "산업경제과", "투자유치과", "도시계획과", "도시재생과", "도시정비과",
    "도시관리과", "건설과", "건설관리과", "건축과", "도로과", "하천과", "교통행정과", "주차관리과", "스마트도시과",
    "정보통신과", "안전총괄과", "재난안전과", "민방위과", "환경위생과", "위생환경과", "청소행정과", "자원순환과",
    "공원녹지과", "산림녹지과", "환경정책과", "문화예술과", "문화체육과", "관광진흥과", "체육지원과", "평생교육과",
    "교육정책과", "평생학습과", "문화관광과", "복지정책과", "사회복지과", "어르신장애인과", "노인복지과", "가족정책과",
    "여성가족과", "아동보육과", "청년정책과", "건강증진과", "보건소", "세무과", "재무과", "회계과", "민원여권과",
    "민원봉사과", "전략사업과", "도시재생지원센터", "시설관리사업소", "의회사무국", "청소년상담복지센터", "장애인복지관",
    "노인복지관", "여성인력개발센터", "전부서", "전동", "전 동", "전 부 서",
)

# Nouns (by ending) that make a session title.
TITLE_NOUN_ENDINGS = (
    "시스템", "서비스", "정책", "규정", "절차", "방법", "기준", "지침", "보고서", "분석", "평가", "계획", "전략", "목표",
    "성과", "결과", "현황", "동향", "전망", "예측", "대응", "개선", "혁신", "지원", "관리", "운영", "추진", "시행", "검토",
    "협의", "논의", "회의", "안건", "사항", "문제", "이슈", "과제", "해결", "방안", "대책", "조치", "통계", "데이터", "정보",
    "자료", "문서", "양식", "서식", "신청", "접수", "처리", "승인", "결재", "통보", "안내", "공지", "홍보", "교육", "연수",
    "심사", "감사", "점검", "모니터링", "피드백", "예술촌", "문화",
)

# Evaluation gates.
GATES = {"exact_match": 0.95, "f1_score": 0.99, "citation_accuracy": 0.995, "hallucination_rate": 0.0}

# Alert rules: metric, comparison, threshold.
ALERT_RULES = (
    ("error_rate", ">", 0.05), ("hallucination_rate", ">", 0.01), ("avg_total_time_ms", ">", 3000.0), ("avg_confidence", "<", 0.7),
)
