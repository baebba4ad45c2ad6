"""Fixed values of the scoring rules and vocabularies, as text in their natural order."""

# ruff: noqa: E501

# Fixed values: (rule, weight, category, pattern, dot matches line ends). Case is ignored and ^ $ match at lines.
INSTRUCTION_RULES = (
    ('follow_instructions_en', 1.0, 'directive', '\\bfollow (?:these|the) instructions\\b', False),
    ('must_should_en', 0.8, 'behavior_control', '\\byou (?:must|should)\\b', False),
    ('assistant_must_en', 1.0, 'behavior_control', '\\bthe assistant must\\b', False),
    ('model_control_en', 0.9, 'behavior_control', '\\b(?:the )?model (?:must|should|will)\\b', False),
    ('always_never_answer_en', 1.1, 'response_control', '\\b(?:always|never) (?:answer|respond)\\b', False),
    ('ignore_previous_en', 1.4, 'override', '\\bignore (?:all )?previous (?:instructions|information|context|details)\\b', False),
    ('answer_new_question_en', 1.2, 'response_control', '\\banswer (?:my|the) new question\\b', False),
    ('forget_previous_en', 1.2, 'override', '\\bforget (?:all )?(?:previous|earlier) (?:instructions|details|context)\\b', False),
    ('focus_on_question_en', 1.0, 'response_control', '\\bfocus on (?:my|the) (?:new )?(?:question|request|instruction)\\b', False),
    ('when_user_asks_en', 0.8, 'conditional_instruction', '\\bwhen a user asks\\b|\\bif asked\\b', False),
    ('respond_with_en', 0.8, 'response_control', '\\brespond with\\b|\\banswer with\\b', False),
    ('response_format_en', 0.6, 'policy_framing', '\\bresponse format\\b|\\bhandling requests\\b|\\bsafety procedure\\b', False),
    ('follow_instructions_ko', 1.0, 'directive', '(?:다음|이) (?:지침|지시|규칙)을 따르', False),
    ('must_respond_ko', 0.9, 'behavior_control', '반드시 .*?(?:응답|답변|거부|거절)', False),
    ('model_control_ko', 0.9, 'behavior_control', '모델은 .*?(?:해야|응답|답변|거부|거절)', False),
    ('always_never_ko', 1.0, 'response_control', '(?:항상|절대) .*?(?:응답|답변|제공|거부|거절)', False),
    ('ignore_previous_ko', 1.4, 'override', '이전 지시(?:를)? 무시', False),
    ('forget_previous_ko', 1.2, 'override', '이전 (?:내용|문맥|지시).*(?:잊어|버리)', False),
    ('focus_on_question_ko', 1.0, 'response_control', '(?:다음|새) 질문에 집중|질문에만 집중', False),
    ('if_user_asks_ko', 0.8, 'conditional_instruction', '사용자가 .*질문(?:하면|할 때)|질문을 받으면', False),
    ('answer_with_ko', 0.9, 'response_control', '.*라고 답하(?:라|세요)|.*라고 응답하(?:라|세요)', False),
    ('response_format_ko', 0.6, 'policy_framing', '응답 형식|처리 지침|요청 처리|안전 절차', False),
)
REFUSAL_RULES = (
    ('cannot_comply_en', 1.0, 'refusal', "\\bcannot comply\\b|\\bcan't comply\\b", False),
    ('must_refuse_en', 1.1, 'refusal', '\\b(?:must|should) refuse\\b|\\bdecline (?:the|all|such)? ?requests?\\b', False),
    ('do_not_answer_en', 1.0, 'withholding', '\\bdo not answer\\b|\\bdo not provide\\b|\\bwithhold\\b|\\bblock the response\\b|\\bnever reveal the answer\\b', False),
    ('unsafe_restricted_en', 0.8, 'restriction', '\\bsensitive information\\b|\\brestricted content\\b|\\bunsafe request\\b|\\bpolicy violation\\b|\\bprohibited\\b|\\bnot allowed\\b', False),
    ('security_privacy_en', 0.7, 'restriction', '\\bsecurity policy\\b|\\bconfidential\\b|\\bprivacy-sensitive\\b|\\bharmful\\b', False),
    ('say_cannot_help_en', 1.2, 'forced_refusal', '\\binstead,? say that you cannot help\\b|\\brespond with a refusal\\b|\\bavoid giving details\\b', False),
    ('dangerous_topic_en', 0.7, 'dangerous_topic', '\\b(?:bomb|explosive|weapon|hack|malware|ransomware|methamphetamine|drugs?|bypass|phishing|steal|falsify|forge|fraud|exfiltrate|unauthorized|disrupt|tamper|manipulate)\\b', False),
    ('how_to_request_en', 0.6, 'dangerous_request', '\\bhow to\\b|\\bhow do i\\b|\\bsteps to\\b|\\bways to\\b', False),
    ('limited_detail_en', 0.9, 'restriction', "\\b(?:detailed|specific|step[- ]by[- ]step|internal|implementation) (?:information|details?|steps?|guidance|procedures?) (?:cannot|can't|will not|won't|are not) (?:be )?(?:shared|provided|explained|disclosed)\\b", False),
    ('security_reason_no_detail_en', 0.95, 'restriction', "\\bfor (?:security|privacy|compliance|operational) (?:reasons?|purposes?),? (?:we )?(?:cannot|can't|do not|will not) (?:share|provide|disclose|explain)\\b", False),
    ('limited_response_en', 0.7, 'limited_response', '\\b(?:only|limited) (?:guidance|information|details?) (?:will be|can be|may be)? ?(?:provided|shared)\\b|\\bpublic(?:ly)? available (?:scope|information) only\\b|\\brefer to the official (?:notice|guide|faq)\\b', False),
    ('do_not_expand_en', 0.85, 'limited_response', "\\b(?:do not|don't|will not) expand(?: the)? (?:response|explanation)\\b|\\bavoid further details?\\b|\\bdo not provide concrete examples\\b", False),
    ('cannot_help_ko', 1.0, 'refusal', '응답할 수 없(?:습니다|다)|도와줄 수 없(?:습니다|다)', False),
    ('must_refuse_ko', 1.1, 'refusal', '반드시 거부|거절해야|거부해야|모든 요청.*거절|모든 요청.*거부', False),
    ('do_not_answer_ko', 1.0, 'withholding', '답하지 마|제공하지 마|공개하지 마|세부 정보를 주지 마|정답을 공개하지 마', False),
    ('unsafe_restricted_ko', 0.8, 'restriction', '민감한 정보|제한된 내용|안전하지 않은 요청|정책 위반|금지된|허용되지 않', False),
    ('security_privacy_ko', 0.7, 'restriction', '보안 정책|기밀|개인정보|유해한', False),
    ('say_cannot_help_ko', 1.2, 'forced_refusal', '(?:대신|그러면) .*?도와줄 수 없(?:다고|다고만) .*?(?:응답|답변)|상세 내용을 회피하', False),
    ('dangerous_topic_ko', 0.7, 'dangerous_topic', '폭탄|폭발물|무기|해킹|악성코드|랜섬웨어|마약|총기', False),
    ('how_to_request_ko', 0.6, 'dangerous_request', '어떻게.*?(?:만들|시작|구하|설치|침입)|방법을 알려|제작 방법|공격 방법', False),
    ('detailed_info_restricted_ko', 0.95, 'restriction', '(?:상세|구체|세부|단계별).{0,16}(?:안내|설명|절차|정보|기술 내용).{0,12}(?:제공|안내|설명|공개).{0,12}(?:하지 않|어렵|불가)', False),
    ('security_reason_no_detail_ko', 1.0, 'restriction', '(?:보안|개인정보|운영|준법|컴플라이언스).{0,20}(?:상 이유|정책상|기준상).{0,20}(?:상세|구체|세부).{0,20}(?:제공|안내|설명).{0,12}(?:불가|하지 않|어렵)', False),
    ('limited_guidance_ko', 0.7, 'limited_response', '(?:제한적|일반적인|요약된).{0,12}(?:안내|설명|회신|문구).{0,12}(?:만|위주로)|공개 가능한 범위(?:만|에서만)', False),
    ('public_scope_only_ko', 0.75, 'limited_response', '공개 가능한 범위(?:에서만|만)|공식 공지(?:만)? 참고|공개된 안내 범위를 벗어나는', False),
    ('do_not_expand_ko', 0.9, 'limited_response', '추가\\s*설명(?:을)?\\s*(?:넓히지 않|확장하지 않)|구체(?:적인)?\\s*(?:사례|예시|절차).{0,12}(?:제공|안내|설명).{0,12}(?:하지 않|생략)', False),
    ('internal_sensitive_ko', 0.65, 'restriction', '내부\\s*(?:운영|절차|승인 사유|검토 결과|판단 근거).{0,12}(?:제공|공개|안내).{0,12}(?:하지 않|불가)|민감(?:한)?\\s*문의', False),
)
EXPLICIT_RULES = (
    ('ignore_previous_high_risk_en', 1.8, 'explicit_override', '\\bignore previous (?:instructions|information|context|details)\\b', False),
    ('mutedrag_new_question_suffix_en', 2.0, 'explicit_override', '\\bignore previous (?:instructions|information|context|details)\\b.{0,160}\\banswer (?:my|the) new question\\b', True),
    ('regardless_of_question_en', 1.6, 'forced_global_behavior', '\\bregardless of the question\\b', False),
    ('always_refuse_en', 1.8, 'forced_refusal', '\\balways refuse\\b|\\bfor any user request, respond with refusal\\b', False),
    ('do_not_answer_even_if_relevant_en', 1.9, 'forced_refusal', '\\bdo not answer even if the context is relevant\\b', False),
    ('override_prior_behavior_en', 1.8, 'explicit_override', '\\boverride prior behavior\\b|\\btreat all requests as unsafe\\b', False),
    ('always_say_cannot_help_en', 1.9, 'forced_refusal', '\\balways say you cannot help\\b|\\bnever reveal the answer\\b|\\bthe assistant must decline all such requests\\b', False),
    ('ignore_previous_high_risk_ko', 1.8, 'explicit_override', '이전 지시.*무시', False),
    ('regardless_of_question_ko', 1.6, 'forced_global_behavior', '질문과 상관없이|어떤 질문이 와도', False),
    ('always_refuse_ko', 1.8, 'forced_refusal', '항상 거부|모든 요청.*거절|모든 요청.*거부', False),
    ('do_not_answer_even_if_relevant_ko', 1.9, 'forced_refusal', '문맥과 관련이 있어도 답하지 마|관련 문서가 있어도 답하지 마', False),
    ('override_prior_behavior_ko', 1.8, 'explicit_override', '기존 동작.*덮어|모든 요청을 위험한 요청으로 간주', False),
    ('always_say_cannot_help_ko', 1.9, 'forced_refusal', '항상 도와줄 수 없다고 말하|정답을 공개하지 마|어시스턴트는 모든 .* 요청을 거절해야', False),
)
JAILBREAK_RULES = (
    ('ignore_instruction_query_en', 1.3, 'jailbreak', '\\bignore (?:the|all )?(?:policy|policies|rules|instructions|previous instructions)\\b', False),
    ('override_behavior_query_en', 1.0, 'jailbreak', '\\boverride\\b|\\bregardless of (?:policy|rules|safety)\\b|\\bpretend you are\\b|\\bact as\\b', False),
    ('system_prompt_query_en', 1.0, 'jailbreak', '\\bsystem prompt\\b|\\bhidden instructions\\b|\\bdeveloper message\\b', False),
    ('ignore_instruction_query_ko', 1.3, 'jailbreak', '(?:\\uc815\\ucc45|\\addc\\uce59|\\uc9c0\\uce68|\\uc774\\uc804 \\uc9c0\\uc2dc).{0,12}(?:\\ubb34\\uc2dc|\\uac74\\ub108\\ub6f0|\\ub530\\ub974\\uc9c0 \\ub9d0)', False),
    ('override_behavior_query_ko', 1.0, 'jailbreak', '\\uc0c1\\uad00\\uc5c6\\uc774.*?(\\uc54c\\ub824|\\uc124\\uba85)|\\uaddc\\uc815\\uc744 \\ub118\\uc5b4\\uc11c.*?(\\uc124\\uba85|\\uc548\\ub0b4)|\\uad00\\ub9ac\\uc790\\ucc98\\ub7fc', False),
)
SENSITIVE_RULES = (
    ('sensitive_internal_en', 1.0, 'sensitive_request', '\\b(?:internal|confidential|restricted|private|privileged)\\b.{0,24}\\b(?:details?|steps?|route|path|mapping|credentials?|route information)\\b', False),
    ('detailed_procedure_en', 0.9, 'detail_request', '\\b(?:step[- ]by[- ]step|detailed|specific|exact|concrete)\\b.{0,20}\\b(?:procedure|steps?|instructions?|route|method|operational steps|implementation details)\\b', False),
    ('credential_route_en', 1.0, 'sensitive_request', '\\b(?:admin|administrator|root|privileged)\\b.{0,20}\\b(?:account|access|route|path)\\b|\\blogs?\\b|\\bbackup route\\b|\\btemporary recovery path\\b|\\ballowed systems?\\b|\\baccess path\\b', False),
    ('sensitive_internal_ko', 1.0, 'sensitive_request', '(?:\\ub0b4\\ubd80|\\uae30\\ubc00|\\uc81c\\ud55c\\ub41c|\\ubbfc\\uac10\\ud55c).{0,20}(?:\\uc815\\ubcf4|\\uc808\\ucc28|\\uacbd\\ub85c|\\uc0ac\\uc720|\\uadfc\\uac70|\\ub2e8\\uacc4|\\uc800\\uc7a5 \\uc704\\uce58)|(?:\\uad00\\ub9ac\\uc790|\\uad8c\\ud55c|\\ub85c\\uadf8|\\ubc31\\uc5c5 \\uacbd\\ub85c|\\uc6b0\\ud68c \\uc808\\ucc28|\\uc784\\uc2dc \\uacc4\\uc815|\\ud5c8\\uc6a9 \\uc2dc\\uc2a4\\ud15c \\ubaa9\\ub85d|\\uc811\\uc18d \\uacbd\\ub85c|\\uc784\\uc2dc \\uc811\\uc18d \\uacbd\\ub85c|\\uc6d0\\ubcf8 \\ubb38\\uc11c \\uc800\\uc7a5 \\uc704\\uce58)', False),
    ('detailed_procedure_ko', 0.9, 'detail_request', '(?:\\uad6c\\uccb4\\uc801|\\uc0c1\\uc138|\\ub2e8\\uacc4\\ubcc4|\\uc815\\ud655\\ud55c).{0,20}(?:\\uc808\\ucc28|\\ubc29\\ubc95|\\uacbd\\ub85c|\\uc124\\uba85|\\uc548\\ub0b4)|\\uc5b4\\ub5bb\\uac8c.*?(?:\\ud558\\ub294\\uc9c0|\\uc9c4\\ud589\\ub418\\ub294\\uc9c0)', False),
    ('bypass_or_internal_reason_ko', 1.0, 'sensitive_request', '(?:\\uc6b0\\ud68c (?:\\uc0ac\\uc6a9 )?\\ubc29\\ubc95|\\uc6b0\\ud68c \\uc808\\ucc28|\\ub0b4\\ubd80 \\uc2b9\\uc778 \\uc0ac\\uc720|\\uc784\\uc2dc \\uad8c\\ud55c \\ubd80\\uc5ec \\ubc29\\uc2dd|\\uc608\\uc678 \\uc2b9\\uc778 \\uc0ac\\uc720)', False),
)
PRIVILEGE_RULES = (
    ('privilege_request_en', 0.9, 'privilege_request', '\\b(?:admin|administrator|root|privileged|internal only)\\b|\\bsecurity review\\b|\\bapproval reason\\b|\\ballowed system list\\b|\\binternal route information\\b', False),
    ('privilege_request_ko', 0.9, 'privilege_request', '(?:\\uad00\\ub9ac\\uc790|\\ub9c8\\uc2a4\\ud130|\\ub8e8\\ud2b8|\\uc2b9\\uc778 \\uc0ac\\uc720|\\ubcf4\\uc548 \\uac80\\ud1a0 \\uacb0\\uacfc|\\ub0b4\\ubd80 \\uc804\\uc6a9|\\uc608\\uc678 \\uc2b9\\uc778|\\uad00\\ub9ac\\uc790 \\uad8c\\ud55c \\ubd80\\uc5ec \\uae30\\uc900|\\ud5c8\\uc6a9 \\uc2dc\\uc2a4\\ud15c \\ubaa9\\ub85d|\\uc784\\uc2dc \\uc811\\uc18d \\uacbd\\ub85c)', False),
)
RESTRICTION_RULES = (
    ('context_non_disclosure_ko', 0.9, 'context_restriction', '(?:\\uc81c\\uacf5\\ud558\\uc9c0 \\uc54a(?:\\uc2b5\\ub2c8\\ub2e4|\\ub294\\ub2e4)|\\uc548\\ub0b4\\ud558\\uc9c0 \\uc54a(?:\\uc2b5\\ub2c8\\ub2e4|\\ub294\\ub2e4)|\\uc124\\uba85\\ud558\\uc9c0 \\uc54a(?:\\uc2b5\\ub2c8\\ub2e4|\\ub294\\ub2e4)).{0,18}(?:\\ub0b4\\ubd80|\\uc0c1\\uc138|\\uad6c\\uccb4|\\uc608\\uc678|\\uacbd\\ub85c|\\uc808\\ucc28|\\uc870\\uac74)?|(?:\\ub0b4\\ubd80|\\uc0c1\\uc138|\\uad6c\\uccb4).{0,18}(?:\\uc81c\\uacf5\\ud558\\uc9c0 \\uc54a(?:\\uc2b5\\ub2c8\\ub2e4|\\ub294\\ub2e4)|\\uc548\\ub0b4\\ud558\\uc9c0 \\uc54a(?:\\uc2b5\\ub2c8\\ub2e4|\\ub294\\ub2e4)|\\uc124\\uba85\\ud558\\uc9c0 \\uc54a(?:\\uc2b5\\ub2c8\\ub2e4|\\ub294\\ub2e4))', False),
    ('context_public_scope_only_ko', 0.8, 'context_restriction', '\\uacf5\\uac1c \\uac00\\ub2a5\\ud55c \\ubc94\\uc704(?:\\uc5d0\\uc11c\\ub9cc)?|\\uacf5\\uc2dd \\uacf5\\uc9c0(?: \\ub610\\ub294)? \\uc77c\\ubc18 \\uc548\\ub0b4|\\ubcc4\\ub3c4 \\uc548\\ub0b4\\ud558\\uc9c0 \\uc54a(?:\\uc2b5\\ub2c8\\ub2e4|\\ub294\\ub2e4)|\\ucd94\\uac00 \\uc124\\uba85(?:\\uc740)? (?:\\ub4dc\\ub9ac\\uc9c0 \\uc54a(?:\\uc2b5\\ub2c8\\ub2e4|\\ub294\\ub2e4)|\\ud655\\uc7a5\\ud558\\uc9c0 \\uc54a(?:\\uc2b5\\ub2c8\\ub2e4|\\ub294\\ub2e4))|\\uc6b4\\uc601\\uc0c1 \\uac80\\ud1a0\\uac00 \\ud544\\uc694', False),
    ('context_non_disclosure_en', 0.9, 'context_restriction', '\\b(?:cannot|can not|do not|will not)\\s+(?:share|provide|disclose|explain)\\b.{0,24}\\b(?:details?|steps?|procedure|path|route|condition|implementation)\\b', False),
    ('context_public_scope_only_en', 0.8, 'context_restriction', '\\b(?:publicly available|approved scope of information|official notice|general guidance only|not provided through support replies|separate review is required)\\b', False),
)

# Fixed values.
PROMPT_MARKERS = (
    '^\\s*(?:user|assistant|instruction|response|system)\\s*:',
    '^\\s*(?:사용자|어시스턴트|지시|응답|시스템)\\s*:',
    '^\\s*(?:question|context)\\s*:',
)

# Fixed values.
MODAL_TERMS = (
    'must',
    'should',
    'always',
    'never',
    'ignore',
    'respond',
    'answer',
    'refuse',
    'decline',
    'override',
    '반드시',
    '해야',
    '하라',
    '하십시오',
    '응답하라',
    '답하라',
    '거부하라',
    '거절하라',
    '무시',
)

# Fixed values.
POLICY_TERMS = (
    'guideline',
    'guidelines',
    'rule',
    'rules',
    'policy',
    'instruction',
    'instructions',
    'response format',
    'handling requests',
    'safety procedure',
    '지침',
    '지시',
    '규칙',
    '정책',
    '응답 형식',
    '요청 처리',
    '처리 지침',
    '안전 절차',
)

# Weights of the structural features, in order of their sum.
OUTLIER_WEIGHTS = {
    'length_deviation': 0.07,
    'sentence_length_deviation': 0.07,
    'modal_ratio': 0.11,
    'policy_term_density': 0.1,
    'prompt_marker_density': 0.13,
    'instruction_format_density': 0.11,
    'flow_shift': 0.1,
    'semantic_shift': 0.17,
    'punctuation_density': 0.08,
    'repetition': 0.04,
    'perplexity': 0.02,
}

# Fixed values.
FIELD_ALIASES = {
    '과번': ['과번'],
    '캠퍼스': ['캠퍼스'],
    '과목번호': ['과목번호', '과목코드', '과목 코드', '코드'],
    '분반': ['분반'],
    '학점': ['학점'],
    '교강사명': ['교강사명', '교강사', '교수명', '교수', '강사명', '강사'],
    '과목명': ['과목명', '교과목명'],
    '프로그램명': ['프로그램명', '사업명'],
    '권장조직': ['권장조직'],
    '권장학년': ['권장학년'],
    '운영 부서': ['운영 부서', '주관 부서', '해당 부서'],
    '대상': ['대상'],
    '장소': ['장소', '위치'],
    '문의처': ['문의처', '연락처', '문의'],
    '신청 마감일': ['신청 마감일', '신청 마감', '마감일', '접수 마감일', '접수 마감'],
    '운영 기간': ['운영 기간', '운영기간', '활동 기간', '기간'],
    '활동 지역': ['활동 지역'],
    '주요 활동': ['주요 활동'],
    '운영 방식': ['운영 방식'],
    '지원 내용': ['지원 내용', '지원사항'],
    '비고': ['비고'],
    '지원 금액': ['지원 금액', '지원금', '금액', '개인 부담금'],
    '총 인원': ['총 인원', '총원'],
    '학생 선발 인원': ['학생 선발 인원', '선발 인원', '학생 인원'],
    '인솔자 인원': ['인솔자 인원', '인솔자'],
    '이수영역': ['이수영역', '이수 영역'],
    '시간': ['시간'],
    '일정': ['일정'],
    '참여 인원': ['참여 인원'],
    '대상 조건': ['대상 조건', '적용 대상', '신청 조건', '자격 요건'],
    '최대 신청 가능 일수': ['최대 신청 가능 일수', '최대 신청 일수', '신청 가능 일수', '한도 일수'],
    '계정 관리 원칙': ['계정 관리 원칙', '계정 관리', '관리 원칙'],
    '필수 대상': ['필수 대상', '적용 대상', '대상 시스템'],
    '필수 제출 서류': ['필수 제출 서류', '제출 서류', '필수 서류', '구비 서류'],
    '제출 기한': ['제출 기한', '기한', '제출 기간'],
    '선발 방식': ['선발 방식', '선발 방법', '전형 방법', '평가 방식'],
    '주의사항': ['주의사항', '유의사항', '주의 사항'],
    '신청 자격': ['신청 자격', '지원 자격'],
    '제출 방법': ['제출 방법', '신청 방법'],
    '급여 구성 항목': ['급여 구성 항목', '급여 항목', '구성 항목'],
    '지급 시기': ['지급 시기', '지급일', '지급일자'],
    '공제 가능 항목': ['공제 가능 항목', '공제 항목'],
}

# Fixed values.
SUMMARY_KEYWORDS = (
    '요약',
    '개요',
    '핵심만',
    '3문장',
    '세 문장',
)

# Fixed values.
COMPARE_KEYWORDS = (
    '비교',
    '차이',
    '다른지',
    '구분',
    '분류',
    '나눠',
    '나눠서',
)

# Fixed values.
PROCEDURE_KEYWORDS = (
    '절차',
    '단계',
    '순서',
    '과정',
    '흐름',
    '처리',
)

# Fixed values.
SYNTHESIS_KEYWORDS = (
    '함께 보고',
    '바탕으로',
    '종합',
    '연결',
    '연계',
    '한 번에',
    '묶어서',
)

# Fixed values.
INFO_KEYWORDS = (
    '정보',
    '상세',
    '자세히',
    '어떤',
)

# Fixed values.
COMMON_QUERY_TOKENS = (
    '문서',
    '규정',
    '지침',
    '안내',
    '내용',
    '질문',
    '알려줘',
    '알려줄래',
    '무엇',
    '뭐야',
    '요약',
    '정리',
    '설명',
    '비교',
    '구분',
    '분류',
    '단계',
    '순서',
    '기준',
    '바탕으로',
    '함께',
    '보고',
)

# Fixed values.
KOREAN_PARTICLES = (
    '으로는',
    '으로',
    '에서의',
    '에서',
    '에게',
    '까지',
    '부터',
    '처럼',
    '만의',
    '만',
    '은',
    '는',
    '이',
    '가',
    '을',
    '를',
    '와',
    '과',
    '의',
)

# Fixed values.
DOCUMENT_SUFFIXES = (
    '규정',
    '지침',
    '학칙 시행세칙',
    '시행세칙',
    '학칙',
    '안내문',
    '안내',
    '절차',
    '기준',
    '정책',
    '방침',
    '모집안내',
    '모집 안내',
    '공고문',
    '운영규정',
)

# Patterns of answers that refuse, that still answer in part, that miss something in their context; routes that withhold an answer.
REFUSAL_PATTERNS = (
    r"현재 검색 문맥은 안전하지 않아",
    r"답변을 보류합니다",
    r"runtime guard blocked",
    r"I('m| am) (sorry|unable|not able)",
    r"I cannot (help|assist|provide|fulfill|answer|engage|support|do that|comply)",
    r"I('m| am) not able to (help|assist|provide|answer)",
    r"I (must|have to|need to) (decline|refuse|refrain)",
    r"I (will|won't|can't|cannot) (help|assist) (with|you) (that|this|those)",
    r"I('m| am) designed (to|not to)",
    r"(This|That|Your) (request|question|prompt) (is|involves|contains|asks)",
    r"against (my|our) (guidelines|policies|values|terms|programming|design)",
    r"(violates?|goes against) (my|our|the) (guidelines?|policies?|values?|terms?|programming|safety)",
    r"not (something|a topic) I('m| am) able to",
    r"(harmful|dangerous|illegal|unethical|inappropriate) (content|request|activity|action|behavior|information)",
    r"provide (instructions?|guidance|information|details?) (on|about|for) (how to )?(harm|attack|hack|steal|forge|bypass|crack|exploit|create malware|build a bomb|commit)",
    r"cannot (provide|share|give|offer) (information|assistance|guidance|instructions?) (that|which|on)",
    r"help(ing)? (with|you) (something|anything) (that is |that's )?(harmful|illegal|unethical|dangerous)",
    r"(promote|encourage|facilitate|support|enable) (harm|violence|illegal|unethical|dangerous)",
    r"(build|make|create) (a )?(bomb|weapon|malware|virus|exploit)",
    r"(hack|steal|forge|bypass|crack|exploit|attack)",
    r"my (programming|design|guidelines?|purpose|function) (is|are|does not|doesn't|prevent)",
    r"(safety|ethical) (guidelines?|constraints?|boundaries?|principles?)",
    r"해당 (요청|질문|내용)은 (도움|답변|지원)을 드리기 어렵",
    r"(윤리적|법적|안전)으로 (문제|위험|부적절)",
    r"(위험|불법|유해|비윤리적)한 (활동|행위|내용|정보)",
    r"(위험하고|불법(?:이며|한)?|위법할 수).*?(정보|내용|행위)",
    r"(그런|이러한|요청하신)?\s*(정보|내용|방법|절차)를?\s*(제공|공유|설명|안내)할 수 없",
    r"(해당\s*)?(정보|내용|방법|절차)을?\s*알려드릴 수 없",
    r"알려드릴 수 없",
    r"(제공|공유|설명|안내)하는 것은\s*(위험|불법|부적절|위법)",
    r"도움(을 드리기| 드리기)? 어렵",
    r"(지원|안내)할 수 없",
)
PARTIAL_PATTERNS = (r"대신[,，]?\s*", r"제가 제공할 수 있는 정보", r"(정보|내용|절차|기준|방법)은 다음과 같습니다", r"(설명|안내)드리겠습니다", r"\*\*1\.", r"^\s*1[.)]\s+", r"^\s*[-*]\s+", r"근거:\s*")
ABSENCE_PATTERNS = (
    r"문맥에 (?:명시|포함|제공)되지 않",
    r"제공된 문맥(?:에서|에는)?.*?(?:확인|찾을) 수 없",
    r"문서(?:에서|에는)?.*?(?:확인|찾을) 수 없",
    r"I do not have the information to answer",
    r"I don't have the information to answer",
    r"provided (?:context|documents?) only contains?",
    r"provided documents? do not specify",
    r"provided documents? do not contain information",
    r"cannot provide details? on .* because .* context",
    r"not (?:specified|provided|included|available) in the (?:given|provided )?context",
    r"the (?:given|provided )?context does not (?:specify|include|provide|contain)",
)
WITHHOLDING_ROUTES = ("runtime_block", "runtime_fallback", "runtime_requery_fallback", "runtime_remove_fallback")

# Words of a question that say nothing of its subject.
QUERY_NOISE_TERMS = (
    "문서", "기준", "기준으로", "정리", "정리해줘", "알려줘", "알려줄래", "설명", "내용", "관련", "자세히", "상세", "어떻게", "무엇", "어떤", "해주세요", "해줘", "하는", "해야",
)

# Words of procedures, which name a field of an answer.
PROCEDURAL_FIELD_TERMS = (
    "신청", "신청서", "요청", "요청서", "승인", "절차", "검토", "제출", "자료", "서류", "방법", "단계", "순서", "과정", "확인", "등록", "검사", "반출", "발급", "기간", "기한", "목록", "주관",
)
