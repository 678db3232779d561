"""Word lists, patterns, constants and names that results depend on."""

# --- fixed values: survey none tokens and text patterns ---
NONE_TOKENS = ("", "없음", "없습니다", "무", ".", "아직 없음", "딱히 없음", "해당없음", "없어요", "x", "X", "none", "nan")
CERT_NONE_TOKENS = ("없음", "없습니다", "무", ".", "아직 없음", "딱히 없음")
CERT_TOKEN_NONE_EXTRA = ("해당없음", "없어요", "없음요")
PREV_CLASS_NONE_TOKENS = ("", "해당없음", "없음", "무", ".", "없습니다")
TOKEN_SPLIT = r"(?U)\s*[,/|;·]\s*|\s+및\s+"
NON_TOKEN_CHARS = r"[^0-9a-zA-Z가-힣]+"
PREPARING_PREFIX = r"(?U)^\s*(준비중|준비|예정)\s*[:：]\s*"
PREPARING_WORD = r"(?iU)(준비중|준비|예정|응시|공부\s*중|계획|취득\s*예정)"
CERT_STATUS_WORDS = r"취득|합격"
CERT_SEPARATORS = r"[\-_/·;:：|]"
PARENTHESISED = r"\([^\)]*\)"
YES_PATTERN = r"(?i)(재등록|yes|y|true|1|o|예|네)"
DOUBLE_MAJOR_PATTERN = "복수|다중|이중"
MEMBER_INFLOW_PATTERN = "기존 학회원|운영진|지인 추천"
REREG_YES, REREG_NO = "예", "아니"
MISSING_CATEGORY = "__MISSING__"

# --- fixed values: survey keyword lists ---
BIGTECH = ("네이버", "카카오", "쿠팡", "토스", "라인", "당근", "배민", "우아한형제들", "구글", "google", "meta", "microsoft", "amazon", "apple")
FINANCE = ("은행", "카드", "증권", "보험", "kb", "국민", "신한", "하나", "우리", "nh", "농협", "삼성카드", "카카오뱅크", "토스뱅크")
GAME = ("넥슨", "크래프톤", "넷마블", "엔씨", "nc", "펄어비스", "스마일게이트")
CHAEBOL = ("삼성", "lg", "현대", "sk", "롯데", "한화", "포스코")
DATA_MAJOR = ("IT", "컴퓨터", "소프트웨어", "인공지능", "AI", "데이터", "통계", "산업", "산업경영")
JOB_WORDS = ("취업", "이직", "포트폴리오", "프로젝트", "현업", "현직", "면접", "커리어")
INFO_PROCESS = ("정보처리기사", "정보 처리 기사")
ONEDAY_TOPICS = {
    "python": ("python",),
    "sql": ("sql",),
    "crawl": ("크롤링", "crawling"),
    "viz": ("시각화", "matplotlib", "seaborn"),
    "ml_dl": ("머신러닝", "딥러닝"),
    "de": ("데이터 엔지니어링", "파이프라인"),
    "portfolio": ("포트폴리오",),
    "tableau": ("태블로", "테블로"),
    "powerbi": ("power bi", "powerbi", "파워비", "파워비아이", "powebi"),
    "ga": ("구글 애널리", "google analy", "google analytics"),
    "contest": ("공모전",),
    "finance": ("금융",),
    "cnn": ("cnn",),
    "rnn_chatgpt": ("rnn", "chatgpt"),
}
WHY_JOIN = {
    "scale_ops": ("큰 규모", "커리큘럼", "운영", "관리"),
    "benefit": ("혜택", "잡 페스티벌", "기업연계", "공모전"),
    "hard_alone": ("혼자", "어려워"),
    "satisfied_prev": ("만족", "이전 기수"),
    "low_burden": ("시간", "부담"),
    "no_test": ("코딩 테스트", "면접"),
    "want_lecture": ("현직자", "강의"),
}
WANT_TO_GAIN = {
    "project": ("프로젝트",),
    "contest": ("공모전",),
    "analysis": ("분석", "데이터 분석", "역량"),
    "network": ("네트워크", "인적"),
    "python_sql": ("python", "sql"),
    "all": ("위 항목 전체", "전체"),
    "collab": ("협업", "함께"),
}
DESIRED_CERTS = {
    "bigdata": ("빅데이터",),
    "sqld": ("sqld",),
    "adsp": ("adsp",),
    "info_process": INFO_PROCESS,
    "tableau": ("태블로", "tableau"),
    "google_analyst": ("구글 애널리",),
}
DOMAIN_CODES = ("K", "J", "M", "R", "U", "C", "O", "P", "Q", "G")
JOB_CODES = tuple("ABCDEFGHIJ")
JOB_EXCEPT_CODES = tuple("ABCDEFGH")
DATA_JOB_CODES = tuple("ABCD")

# --- fixed values: survey bins, limits and optional columns ---
SEMESTER_MAX = 20
SEMESTER_BINS = ((2, "0-2"), (4, "3-4"), (6, "5-6"), (8, "7-8"), (20, "9-20"))
TIME_BINS = ((1, "<=1"), (2, "1-2"), (3, "2-3"), (4, "3-4"), (None, ">4"))
SCHOOL_TOP, SCHOOL_RARE = 30, 2
MAJOR_TOP, MAJOR_RARE = 20, 1
COMPANY_TOP = 60
CERT_TOKEN_MAX_LEN = 40
OPTIONAL_COLUMNS = (
    "major1_2", "class2", "class3", "class4", "contest_participation",
    "previous_class_3", "previous_class_4", "previous_class_5", "previous_class_6", "previous_class_7", "previous_class_8",
)
CONTEST_COLUMNS = ("contest_participation", "contest_award", "idea_contest")
SURVEY_KEYS = ("id", "ID", "Id", "index", "idx")
RAW_SURVEY_FEATURES = (
    "class1", "re_registration", "inflow_route", "time_input", "whyBDA", "what_to_gain", "major type", "major1_1", "major1_2",
    "major_data", "job", "desired_career_path", "project_type", "hope_for_group", "incumbents_level", "incumbents_company_level",
    "incumbents_lecture", "incumbents_lecture_type", "incumbents_lecture_scale",
)
FORCED_CATEGORIES = (
    "class1", "re_registration", "inflow_route", "school1_topk", "job", "desired_career_path", "project_type", "hope_for_group",
    "incumbents_level", "incumbents_company_level", "incumbents_lecture", "incumbents_lecture_type", "incumbents_lecture_scale",
    "major type", "major1_1", "major1_2", "completed_semester_bucket", "time_input_bucket", "prev_class_latest_code",
    "expected_domain_primary_code", "whyBDA", "what_to_gain", "ic_primary_topk", "major_pair",
)

# --- fixed values: event sequences ---
NO_END_TYPES = (
    "Aerial Clearance", "Block", "Catch", "Deflection", "Error", "Foul", "Handball_Foul", "Hit", "Intervention", "Parry", "Take-On",
)
FIELD = (105.0, 68.0)
DT_CLIP, DT_REF = 60.0, 60.0
CLOCK_CLIP, CLOCK_REF = 4000.0, 3600.0
MIN_MOVE_M = 1e-3
PAD_INDEX, UNKNOWN_INDEX, FIRST_INDEX = 0, 1, 2
SEQUENCE_NUMBERS = (
    "sx_abs", "sy_abs", "ex_abs", "ey_abs", "sx_rel", "sy_rel", "ex_rel", "ey_rel", "end_mask", "dx", "dy", "dist",
    "angle_sin", "angle_cos", "dt", "t_abs_log", "is_second_half", "idx_norm", "steps_to_target", "anchor_x", "anchor_y",
)
SEQUENCE_CATEGORIES = ("player_id", "team_id", "type_name", "result_name")

# --- fixed values: labelled tabular data ---
LABELS = {"Absence": 0, "Presence": 1}
TABULAR_TYPES = {
    "id": "int", "Age": "smallint", "Sex": "tinyint", "Chest pain type": "tinyint", "BP": "smallint", "Cholesterol": "smallint",
    "FBS over 120": "tinyint", "EKG results": "tinyint", "Max HR": "smallint", "Exercise angina": "tinyint", "ST depression": "float",
    "Slope of ST": "tinyint", "Number of vessels fluro": "tinyint", "Thallium": "tinyint", "Heart Disease": "string",
}
TABULAR_CATEGORIES = (
    "Sex", "Chest pain type", "FBS over 120", "EKG results", "Exercise angina", "Slope of ST", "Number of vessels fluro", "Thallium",
)

# boosted-tree settings by config: (depth, learning rate)
ENSEMBLE_CONFIGS = {"m1": (6, 0.03), "m2": (7, 0.025), "m3": (5, 0.04)}
# most boosting rounds by preset
PRESETS = {"robust": 5000, "fast": 1500, "aggressive": 7000}

# --- fixed values: column roles and drift limits ---
TARGET_NAMES = ("answer", "target", "y", "power", "power_consumption", "electricity", "kwh")
COMBINED_KEY_NAMES = ("num_date_time", "id", "row_id")
ENTITY_KEY_NAMES = ("num", "building", "building_id", "bld_id", "site_id", "건물번호")
DATETIME_NAMES = ("date_time", "datetime", "timestamp", "time", "ds", "일시")
DIMENSION_KEY_NAMES = ("num", "building", "building_id", "bld_id", "site_id")
TARGET_WORDS = ("target", "answer", "label", "labels", "y", "kwh", "power", "electric", "electricity", "전력", "소비", "소비량")
HARD_TARGETS = ("전력소비량(kWh)", "전력소비량", "소비전력(kWh)")
HARD_DROPS = ("풍속(m/s)", "일조(hr)")
FORCED_NUMBERS = ("ESS저장용량(kWh)", "PCS용량(kW)")
PLACEHOLDERS = ("-", "—", "–", "", "NaN", "nan", "없음", "무", "None", "none")
NUMBER_PLACEHOLDERS = ("-", "", "NaN", "nan")
NULL_GAP = 0.95
RANGE_QUANTILES = (0.01, 0.99)
RANGE_EPS = 1e-12
HISTOGRAM_BINS = 32
MIN_OVERLAP = 0.02
SEPARABLE_AUC = 0.995
NUMERIC_SHARE = 0.6
SPARSE_SHARE = 0.8
