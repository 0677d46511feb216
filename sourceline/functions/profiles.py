"""Language profiles: the closed vocabularies the rules work with.

A profile is data. ``KOREAN`` holds the values the rules were made for; ``LATIN`` gives the
same rules something to match in English, French, German and Spanish text.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CoreKind:
    id: str
    label: str
    words: tuple[str, ...]


@dataclass(frozen=True)
class Profile:
    name: str
    alphabet: str                                # characters the garble test counts
    letter: str                                  # characters that count as letters
    fillers: tuple[str, ...]
    question_cue: str                            # regex
    talk_words: tuple[str, ...]
    stopwords: tuple[str, ...]
    generic: tuple[str, ...]
    one_char_skip: tuple[str, ...]
    meta_expand: dict[str, tuple[str, ...]]      # generic question word -> deck-side terms
    meta_triggers: tuple[tuple[str, tuple[str, ...]], ...]   # regex -> deck-side terms
    related_cue: str                             # regex
    qtype_rules: tuple[tuple[str, str], ...]     # ordered (label, regex)
    qtype_default: str
    limit_type: str                              # the type that gets deflection phrases
    line_pref: dict[str, str]                    # type -> regex
    heading: str                                 # regex
    counted: str                                 # regex: number with a counting unit
    open_end: str                                # regex: line end that cannot end a sentence
    core_kinds: tuple[CoreKind, ...]
    summary_kind: str
    links: tuple[str, ...]
    default_links: dict[str, tuple[str, ...]]
    query_expansion: dict[str, str] = field(default_factory=dict)
    deflect: tuple[str, ...] = ()
    advice: tuple[str, ...] = ()
    none_word: str = "없음"
    roles: tuple[str, ...] = ()
    page_relations: tuple[str, ...] = ()
    knowledge_relations: tuple[str, ...] = ()
    same_relation: str = "같은내용"
    courtesy: tuple[str, ...] = ()
    filler_sounds: tuple[str, ...] = ()
    demonstratives: tuple[str, ...] = ()


# ---- fixed values: Korean profile -----------------------------------------------------
_WHY = ("문제", "배경", "목적", "필요", "현황", "우려", "해결")
_LIMIT = ("한계", "다만", "향후", "과제", "리스크", "제외", "가상", "근사")
_MERIT = ("차별", "기존", "대비", "비교", "강점", "효과", "절감")
_PLAN = ("목표", "계획", "로드맵", "단계", "출시", "확장")
_WHAT = ("개요", "소개", "플랫폼", "해결", "목표", "핵심")
_HOW = ("방법", "구현", "구조", "단계", "과정", "기술", "설계", "구성")
_EFFECT = ("효과", "기대", "절감", "개선")

KOREAN = Profile(
    name="korean",
    alphabet="[가-힣]",
    letter="[가-힣A-Za-z]",
    fillers=("어", "음", "아", "그", "저", "네", "예", "응", "엄", "흠", "저기",
             "그니까", "그러니까", "뭐", "이제", "약간", "좀"),
    question_cue=r"어떻게|어째서|왜|무엇|뭐|뭘|어떤|언제|누가|얼마|몇|\?|나요|까요|습니까|했나|했어|인가|인지|을까|를까",
    talk_words=("생각", "말씀", "설명", "질문", "의견", "얘기", "이야기", "혹시", "개인",
                "부분", "정도", "어느", "무엇", "뭐", "거", "것", "점"),
    stopwords=("경우", "위해", "통해", "대한", "때문", "여기", "거기", "정도", "부분", "다음",
               "이것", "그것", "저것", "우리", "저희", "자료", "내용", "결과", "방법", "사용",
               "첫째", "둘째", "셋째", "넷째", "이상", "이하", "가지", "관련", "기준"),
    generic=("실제", "성능", "영상", "사진", "대신", "지점", "반복", "사용", "확인", "적용",
             "분석", "데이터", "결과", "경우", "중심", "기준", "대상", "전체", "일부", "이후",
             "지역", "구역", "발생", "수행", "진행", "가능", "필요", "포함", "선정", "산출"),
    one_char_skip=("때", "밖", "안", "앞", "뒤", "위", "중", "내", "후", "전",
                   "시", "점", "수", "것", "등", "말", "줄", "면", "간", "식"),
    meta_expand={
        "프로젝트": (), "서비스": (), "발표": (), "연구": (), "시스템": (), "아이디어": (), "작품": (),
        "주제": (), "내용": (),
        "이유": _WHY, "계기": _WHY, "배경": _WHY, "동기": _WHY, "목적": _WHY, "필요성": _WHY,
        "한계": _LIMIT, "단점": _LIMIT, "약점": _LIMIT, "리스크": _LIMIT, "문제점": _LIMIT, "보완": _LIMIT,
        "장점": _MERIT, "강점": _MERIT, "차별점": _MERIT, "차별성": _MERIT, "차이": _MERIT, "경쟁력": _MERIT,
        "계획": _PLAN, "향후": _PLAN, "앞으로": _PLAN, "목표": _PLAN, "방향": _PLAN,
        "효과": _EFFECT, "기대효과": _EFFECT,
        "의의": _MERIT + _WHY, "가치": _MERIT + _WHY, "중요성": _WHY, "의미": _MERIT + _WHY,
    },
    meta_triggers=((r"왜|어째서", _WHY), (r"뭔가|뭐예|뭐에요|무엇|뭐하는|어떤 거", _WHAT),
                   (r"어떻게|어떤 방법|어떤 식", _HOW)),
    related_cue=r"여러분|팀|발표|이거|이것|이 서비스|이 프로젝트|왜|어떻게",
    qtype_rules=(
        ("한계반론", r"한계|배제|흔들|놓쳤|아닌가|않나요|예측할 수|전부 실제|믿어도"),
        ("근거", r"왜 |왜하|근거|확인하셨|검증|사례가 있나"),
        ("절차", r"어떻게|어떤 방식|어떤 기준|기준으로|순서|나누셨|나누신|처리하셨|바꾸신|추리신|쓰신 거"
                r"|먼저 보|먼저 하|매길 때|정하신|정한 건"),
    ),
    qtype_default="사실확인",
    limit_type="한계반론",
    line_pref={
        "사실확인": r"[0-9][0-9,.]*\s*(?:%|[가-힣]{1,2}|배)|\$\s?[0-9]|[0-9],[0-9]{3}|[0-9]\.[0-9]",
        "절차": r"[①②③④⑤]|규칙|순서|단계|먼저|→",
        "근거": r"p\s*=|ρ|배 |%|검증|대조|유의",
        "한계반론": r"한계|아니라|제외|다만|가상|근사|못 |반영되지",
    },
    heading=r"^[\[\(<※★①-⑤]|^STEP\s|^\s*[-•]\s*$",
    counted=r"[0-9][0-9,\.]*\s*(?:건|개|곳|장|회|명|배|%|위)",
    open_end=r"[가-힣]*(?:은|는|이|가|을|를|의|에|로|와|과|도|지|여|어|아|고|며|서|게|데|할|한|된|될)$",
    core_kinds=(
        CoreKind("significance", "이 프로젝트의 의의", ("의의", "가치", "중요성", "의미")),
        CoreKind("why", "이 프로젝트를 만든 이유", ("이유", "계기", "배경", "동기", "목적", "필요성", "왜")),
        CoreKind("merit", "기존과 다른 점, 장점", ("장점", "강점", "차별", "경쟁력", "차이", "다른 점", "나은 점")),
        CoreKind("limit", "이 프로젝트의 한계", ("한계", "단점", "약점", "리스크", "보완", "아쉬운")),
        CoreKind("plan", "앞으로의 계획", ("계획", "향후", "앞으로", "로드맵", "확장", "발전 방향")),
        CoreKind("effect", "기대 효과", ("효과", "기대효과", "기대되는", "도움이")),
        CoreKind("target", "누가 쓰는가", ("대상", "타깃", "사용자", "누가 쓰", "누구를", "고객")),
        CoreKind("summary", "한 줄로 설명하면", ("한 줄", "한마디", "요약", "뭔가요", "무엇인가요", "뭐예요", "뭐하는")),
    ),
    summary_kind="summary",
    links=("그래서", "근거는", "즉", "예를 들어", "다만", "그럼에도", "덧붙이면",
           "그 결과", "다음으로", "마지막으로", "왜냐하면", "검증은"),
    default_links={"사실확인": ("근거는", "덧붙이면"), "절차": ("다음으로", "마지막으로"),
                   "근거": ("근거는", "검증은"), "한계반론": ("다만", "그럼에도")},
    query_expansion={"절차": "규칙 선정 기준 순서 단계 우선 과정 방식", "근거": "검증 확인 결과 비교 근거 유의",
                     "한계반론": "한계 주의 다만 제외 아니다 유지율", "사실확인": ""},
    deflect=("그 부분은 저희도 한계로 보고 있습니다. 자료에 이렇게 적어뒀습니다 —",
             "정확히 답하려면 질문 범위를 조금 좁혀주실 수 있을까요?"),
    advice=("그 부분은 이번 분석 범위에 넣지 않았습니다.",
            "질문 의도를 조금만 더 구체적으로 말씀해주시겠어요?",
            "확인해서 따로 답변 드리겠습니다."),
    roles=("소개", "문제", "방법", "결과", "근거", "한계", "제안"),
    page_relations=("근거", "원인", "방법", "결과", "예시", "한계", "이어짐"),
    knowledge_relations=("근거", "원인", "결과", "방법", "예시", "한계", "같은내용"),
    courtesy=(
        r"안녕하세요[.,!]*",
        r"(?:발표|설명)\s*(?:정말|아주|너무|진짜)?\s*잘\s*들었습니다[.,!]*",
        r"(?:좋은\s*)?발표\s*감사합니다[.,!]*",
        r"수고\s*많?으?셨습니다[.,!]*",
        r"질문\s*(?:하나|한\s*가지|몇\s*가지)?\s*(?:드려도\s*될까요|드리겠습니다|드릴게요|드립니다|있습니다|있는데요|할게요|하겠습니다)[.,?]*",
        r"궁금한\s*(?:게|점이|것이|부분이)\s*(?:하나|좀)?\s*있는데요?[.,]*",
    ),
    filler_sounds=("어+", "음+", "으+음+", "흠+", "엄+", "아+", "에+", "에헤", "그러니까요?",
                   "뭐랄까요?", "뭐지", "뭐냐면", "있잖아요?", "저기요"),
    demonstratives=("그", "저", "이", "요"),
)
# ---- end of fixed values ---------------------------------------------------------------

_AIM = ("thing", "thin", "rest")
_WAY = ("than", "thre", "sich")

LATIN = Profile(
    name="latin",
    alphabet=r"\p{L}",
    letter=r"\p{L}",
    fillers=("the", "of", "and", "a", "to", "in", "de", "la", "der", "die", "en", "und", "le", "es", "el"),
    question_cue=r"wh|qu|\?",
    talk_words=("is", "was", "it", "be", "are", "for", "by"),
    stopwords=("that", "with", "this", "from", "les", "des", "que", "und", "den"),
    generic=("tion", "thth", "sich", "pour"),
    one_char_skip=(),
    meta_expand={"that": (), "with": _AIM, "this": _WAY, "from": _AIM + _WAY, "les": ("pour", "dans"),
                 "den": ("nicht", "sich"), "que": ("para", "con")},
    meta_triggers=((r"why|warum|pour", _AIM), (r"how|comment|wie", _WAY)),
    related_cue=r"this|why|how",
    qtype_rules=(("limit", r"not|nicht|pas |only"), ("reason", r"why|be|pour|warum"), ("steps", r"how|then|wie|dans")),
    qtype_default="fact",
    limit_type="limit",
    line_pref={"fact": r"[0-9]|the ", "steps": r"first|then|thre", "reason": r"es |%", "limit": r"not |nicht"},
    heading=r"^[\[\(<]|^STEP\s|^\s*[-•]\s*$",
    counted=r"[0-9][0-9,\.]*\s*(?:%|x)",
    open_end=r"(?:the|of|de|der|la|and|und|et)$",
    core_kinds=(
        CoreKind("why", "why this was made", ("why", "warum", "ere")),
        CoreKind("limit", "limits of this", ("not", "nicht", "ohne", "err")),
        CoreKind("plan", "what comes next", ("next", "plan", "zuk")),
        CoreKind("effect", "expected effect", ("effect", "ü")),
        CoreKind("summary", "in one line", ("in one", "tion", "lich")),
    ),
    summary_kind="summary",
    links=("so", "because", "but", "next", "finally"),
    default_links={"fact": ("because", "also"), "steps": ("next", "finally"),
                   "reason": ("because", "so"), "limit": ("but", "still")},
    query_expansion={"steps": "rule order step thre", "reason": "check result ther", "limit": "limit except not",
                     "fact": ""},
    deflect=("We see that as a limit, too.", "Could you narrow the question down?"),
    advice=("That was outside the scope.", "Could you be more specific?", "We will follow up."),
    none_word="none",
    roles=("intro", "problem", "method", "result", "limit"),
    page_relations=("A", "N", "R"),
    knowledge_relations=("A", "N", "R"),
    same_relation="R",
    courtesy=(r"[Hh]ello[.,!]*", r"[Tt]hank you[.,!]*", r"[Ii]n die\b[.,]*"),
    filler_sounds=("uh+", "um+", "er", "ou", "en", "la"),
    demonstratives=("that", "this", "the"),
)
