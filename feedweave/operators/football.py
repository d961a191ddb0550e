"""What the football association's feed looks for: words, the cues that they give, and how a text is cut.

Names of places are parameters; everything else here is fixed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.operators.classify import Classifier, Field, Issue, Person, Rules, distinct, has, segments
from feedweave.operators.evidence import Cues, Lexicon, Link, Parts, Reader, clauses, each, words

# Words of the feed.
AUDIT_STEPS = each("감사 ", words("착수, 결과, 발표, 보고서, 처분, 지적, 후속"))
IN_ENGLISH = words("National␣Assembly, parliamentary, hearing, presidential␣election, election␣deadline, football␣reform")
TEAM = words("국가대표팀, 국가대표, 대표팀")
SPORTS = words("야구, 농구, 아이스하키, 필드하키, 하키, 배구, 핸드볼, 럭비, 풋살, 탁구, 배드민턴, 테니스, 수구, 크리켓, 소프트볼, e 스포츠, 이스포츠")
MORE_SPORTS = words("골프, 사격, 양궁, 태권도, 유도, 레슬링, 수영, 육상, 빙상, 스키")
LEAGUES = words("<KBO>, <KBL>, <WKBL>, <KOVO>, <KHL>, <MLB>")
COUNTRIES = words(
    "독일, 이탈리아, 일본, 이집트, 예멘, 가나, 포르투갈, 스페인, 프랑스, 잉글랜드, 영국, 스코틀랜드, 웨일스, 아일랜드, 브라질, 아르헨티나, 우루과이, 파라과이, 칠레, 콜롬비아, 에콰도르, 페루, 볼리비아, 베네수엘라, 네덜란드, 벨기에, 크로아티아, 세르비아, 슬로베니아, 슬로바키아, 체코, 폴란드, 루마니아, 불가리아, 헝가리, 오스트리아, 스위스, 덴마크, 스웨덴, 노르웨이, 핀란드, 아이슬란드, 그리스, 우크라이나, 러시아, 튀르키예, 터키, 미국, 멕시코, 캐나다, 호주, 뉴질랜드, 중국, 대만, 홍콩, 베트남, 태국, 캄보디아, 인도네시아, 말레이시아, 싱가포르, 필리핀, 미얀마, 인도, 파키스탄, 방글라데시, 네팔, 사우디, 사우디아라비아, 카타르, 이라크, 이란, 요르단, 오만, 아랍에미리트, UAE, 쿠웨이트, 바레인, 시리아, 레바논, 이스라엘, 팔레스타인, 우즈베키스탄, 카자흐스탄, 키르기스스탄, 타지키스탄, 투르크메니스탄, 북한, 남아공, 남아프리카공화국, 모로코, 알제리, 튀니지, 나이지리아, 카메룬, 세네갈, 코트디부아르, 말리, 기니, 콩고, 우간다, 케냐, 탄자니아, 잠비아, 짐바브웨, 日, 中, 美, 獨, 佛, 英, 伊"
)
MORE_COUNTRIES = words(
    "알바니아, 조지아, 보스니아, 헤르체고비나, 몬테네그로, 북마케도니아, 마케도니아, 코소보, 몰도바, 리투아니아, 라트비아, 에스토니아, 벨라루스, 룩셈부르크, 리히텐슈타인, 몰타, 키프로스, 아르메니아, 아제르바이잔, 라오스, 브루나이, 동티모르, 몽골, 아프가니스탄, 스리랑카, 몰디브, 부탄, 수단, 에티오피아, 르완다, 부룬디, 앙골라, 모잠비크, 보츠와나, 나미비아, 말라위, 가봉, 감비아, 라이베리아, 시에라리온, 토고, 베냉, 부르키나파소, 니제르, 차드, 모리타니, 마다가스카르, 모리셔스, 카보베르데, 적도기니, 코스타리카, 파나마, 온두라스, 과테말라, 엘살바도르, 니카라과, 자메이카, 아이티, 쿠바, 도미니카공화국, 트리니다드토바고"
)
BETWEEN_COUNTRY_AND_BODY = r"\s*(?:(?:현지의?|측(?:의|도|은|는|이|가|에서)?|에서|의|도|은|는|이|가)\s*|[,·:：/()\[\]{}'‘’\"“”\-–—]\s*)*"
BETWEEN_PLACE_AND_BODY = r"(?:특별시|광역시|특별자치시|특별자치도|도|시|군|구)?\s*"
BETWEEN_DISTRICT_AND_BODY = r"\s*구\s*"
_MARKS = r"[\s()\[\]{}·,，/:：|｜'‘’\"“”\-–—]*"
_KFA, _NO_KFA = r"(?<![A-Za-z0-9_])KFA(?![A-Za-z0-9_])", r"(?!\s*(?:축구협회|프로축구연맹))"
_OTHER = rf"(?:한국|대한){_NO_KFA}[가-힣]{{1,18}}(?:협회|연맹|산업협회)"
_OTHER_IN_ENGLISH = r"Korean?\s+(?!Football\s+Association(?![A-Za-z0-9_]))[A-Za-z][A-Za-z&'‘’\- ]{0,48}(?:Association|Federation)"
_HOME = r"(?:대한\s*축구협회|Korean?\s+Football\s+Association)"
OTHER_IDENTITY = rf"(?i)(?:{_OTHER}{_MARKS}{_KFA}|{_KFA}{_MARKS}{_OTHER}|{_OTHER_IN_ENGLISH}{_MARKS}{_KFA}|{_KFA}{_MARKS}{_OTHER_IN_ENGLISH})"
HOME_IDENTITY = rf"(?i)(?:{_HOME}{_MARKS}{_KFA}|{_KFA}{_MARKS}{_HOME}|대한\s*축구협회)"
OTHER_SUBJECT = r"(?i),\s*(?=(?:대한체육회|국민체육진흥공단|대한(?:야구|농구|아이스하키|배구|핸드볼|럭비|풋살)협회|한국야구위원회|(?<![A-Za-z0-9_])(?:KBO|KBL|WKBL|KOVO)(?![A-Za-z0-9_])|국민의힘|더불어민주당))"
SHORT_CORE = words("정관, 국회, 국회의원, 문체위, 청문회, 책임, 비판, 개혁, 쇄신, 정치, 카르텔, 밀실, 부패, 비리, 무너, 권력, 실세, 폭로, 저격, 문제, 바뀌, 회유, 사유화, 독점, 해산, 임원진, 핵심 실무진, 후원, 출연금, 재정, 참관단, 출장비")
SHORT_BEFORE = words("축구, 한국 대표팀, 한국 국가대표, 대한민국 대표팀, 전력강화위원, 전강위, 감독 선임, 사령탑, 회장 선거, 선출, 선거인단") + SHORT_CORE
KFA_CUES = words("전력강화위원, 전강위, 감독 선임, 회장 선거, 선거인단, 정관, 청문회, 개혁, 쇄신, 후원, 출연금, 재정, 참관단, 출장비") + AUDIT_STEPS + IN_ENGLISH
NATIONAL_CUES = words(
    "국회, 국회의원, 문체위, 청문회, 문체부, 문화체육관광부, 전력강화위원, 감독 선임, 선출, 선출 기한, 선거인단, 직선제, 간선제, 체육관 선거, 직무대행, 정관, 규정 개정, 구조 개혁, 해명, 사퇴, 징계, 수사, 조사, 책임, 비판, 개혁, 쇄신, 반발, 발언, 저격, 막말, 의혹, 논란, 비리, 부패, 숨은 실세, 숨은 권력, 핵심 실무진, 폭로, 회유, 사유화, 독점, 카르텔, 해산, 임원진, 후원, 출연금, 재정, 참관단, 출장비"
) + each(("", "회장 ", "보궐 ", "회장 보궐 "), "선거", ("", "제도", "제", "방식", "규정", "기한"))
ACCOUNTS = words("청문회, 조사, 해명, 사퇴, 선거, 선거인단, 정관, 징계, 소송, 가처분, 이사회, 집행부, 전력강화위원회, 감독 선임, 선임 절차, 제도 개편, 거버넌스, 혁신, 개혁, 쇄신, 대수술, 대변혁, 구조, 카르텔, 비리, 무원칙, 책임, 논란, 비판, 직격, 후속 조치")
THANKS = words("감사한 마음, 감사한 뜻, 감사한 인사, 진심으로 감사, 감사의 말, 감사의 뜻, 감사의 마음, 감사의 인사, 감사 합니다, 감사 드립니다, 감사 드려요, 감사 해요, 감사 인사, 감사 패, 감사 의 뜻, 감사 를 전, 감사 전, 감사 마음, 고맙의 마음")
EXPLICIT_AUDIT = each(words("문체부, 문화체육관광부"), (" ", " 의 "), ("", "특별 ", "특정 "), "감사") + words("특별 감사, 특정 감사") + each("감사 ", words("착수, 결과, 발표, 보고서, 처분, 요구, 지적, 조사, 후속 조치, 재심의, 수감")) + each(("감사 ", "감사를 "), words("받, 벌이, 실시, 진행, 요구, 청구"))
PEOPLE = words("홍명보, 정몽규, 허정무, 이임생, 박지성, 김병지, 이영표, 신문선")
LOCAL_ACTS = words("옹호, 희생, 잘못, 발언, 논란, 비판, 반박, 막말, 직격, 지적, 사퇴 요구, 혁신위원, 개혁 후퇴, 개혁 필요, 개혁 촉구, 회장 출마, 정몽규 체제") + each("뭘 ", words("안다고, 아나, 아냐, 알아")) + each(words("원래, 원상태"), "로 돌아가", ("", "진", "지는", "지"), " 않")
DIRECT = words("청문회, 회장 후보, 회장 선거, 회장 출마, 후보 등록, 보궐 선거, 선출, 직선제, 간선제, 체육관 선거, 정관, 혁신위, 개혁, 혁신, 쇄신, 숨은 실세, 숨은 권력, 핵심 실무자, 카르텔, 참관단, 출장비, 후원, 출연금, 재정, 임시 감독 체제") + each("감독 ", ("", "공개 "), words("채용, 모집, 선임"))
CLUBS = words("해외, 현지, 유럽, 프로팀, 구단, 클럽, 맨유, 맨체스터, 리버풀, 첼시, 아스널, 토트넘, 바르셀로나, 레알, 뮌헨, 도르트문트, PSG")
TRACKED = words("문체부, 문화체육관광부, 대한축구협회장, 대한 축구협회장, 축구협회장, K-축구혁신위원회, K-축구 혁신, K- 축구 혁신, 축구혁신위, 축구 혁신, 혁신위, 박지성 혁신위, 회장 선거, 선거인단, 정관, 감사 결과, 특정 감사, 행정소송, 징계, 청문회, 이사회, 집행부, 전력강화위원, 전력강화위원회, 대표팀 감독 선임, 감독 선임 절차, 제도 개편, 거버넌스, 인물보다 구조, 후속 조치")
STRONG_ISSUE_WORDS = words("감독 선임, 감독 후보, 전력강화위원회, 문체부 감사, 문화체육관광부 감사, 조사 결과, 회장 선거, 선거인단, 선거인, 후보 등록, 정관, 정관 개정, 규정 개정, 제도 개편, K-축구혁신위원회, 축구혁신위, 혁신위원회, 축구 혁신")
FOOTBALL_WORDS = words("대한축구협회, 대한 축구협회, 대한축구협회장, 대한 축구협회장, 축구협회, 축구협회장, K-축구혁신위원회, K-혁신위, 축구혁신위, 축구 혁신, 한국 축구, 대표팀 감독, 대표팀 감독 선임, 전력강화위원회")
DOMESTIC = words("대한축구협회, 대한 축구협회, 한국 축구, 한국축구, 대한민국 축구, 한국 대표팀, 한국 국가대표, 대한민국 대표팀, 한국프로축구연맹, 프로축구연맹, K리그, 전력강화위원회, 전력강화위원")
SIGNALS = words("국회, 국회의원, 문체위, 청문회, 문체부, 문화체육관광부, 감독 선임, 선임 절차, 전력강화위원, 회장 선거, 선출, 선거인단, 직선제, 간선제, 정관, 징계, 소송, 가처분, 이사회, 집행부, 제도 개편, 제도 개선, 규정 개정, 거버넌스, 혁신, 개혁, 쇄신, 사퇴, 퇴진, 책임, 비판, 반발, 발언, 저격, 막말, 의혹, 논란, 후원, 출연금, 재정, 고발, 배임, 수사, 조사, 부조리, 비위, 위법, 파헤, 참관단, 출장비")
GENERIC_CUES = words("국회, 국회의원, 문체위, 청문회, 문체부, 회장 선거, 선출, 선거인단, 직선제, 간선제, 정관, 규정 개정, 감독 선임, 전력강화위원, 징계, 가처분, 이사회, 집행부, 책임, 비판, 반발, 발언, 저격, 막말, 의혹, 논란, 개혁, 쇄신, 후원, 출연금, 재정, 고발, 배임, 수사, 조사, 참관단, 출장비")

FAMILIES: dict[str, tuple[str, ...]] = {
    "kfa": ("<KFA>",),
    "kfa_matter": words("축구, 대표팀, 국가대표") + KFA_CUES,
    "kfa_cue": KFA_CUES,
    "kfa_more": words("책임, 카르텔, 밀실, 비리, 부패, 거버넌스, 선거 제도, 진상 규명, 문책, 공정, 인맥"),
    "kfa_account": AUDIT_STEPS + words("청문회, 조사, 해명, 사퇴, 징계, 소송, 가처분, 이사회, 집행부, 전력강화위원, 감독 선임, 선임 절차, 제도 개편, 거버넌스, 혁신, 쇄신, 책임, 논란, 비판, 후원, 출연금, 재정, 참관단, 출장비") + IN_ENGLISH,
    "other_field": words("산림, 영화, 패션, 의류, 컬렉션, 디자이너, 쇼핑, 뷰티, 화장품, 가구, 식품, 전자제품, 프랜차이즈, 외식업, 가맹점, 조찬포럼, fashion, forestry, film, franchise, financial, 미국 대통령, 미국 대선, 대통령 선거인단"),
    "home_team": words("대표팀, 국가대표, 전력강화위원, 전강위"),
    "home_process": words("감독 선임, 청문회, 정관, 회장 선거") + AUDIT_STEPS,
    "chair_vote": words("회장 선거"),
    "direct_vote": words("직선제"),
    "short": words("축협"),
    "short_after": SHORT_BEFORE + words("회장"),
    "short_before": SHORT_BEFORE,
    "short_governance": words("국회, 국회의원, 문체위, 청문회, 책임, 비판, 개혁, 쇄신, 정치, 카르텔, 밀실, 부패, 비리, 무너, 권력, 실세, 폭로, 저격, 회유, 사유화, 독점, 해산, 임원진, 후원, 출연금, 재정, 참관단, 출장비"),
    "coop_phrase": words("축협 조합장, 지역 축협 회장, 축산업 협동조합, 축산 협동조합, 농축협, 농·축협, 농ㆍ축협, 축산 농가, 축산 조합, 축산 업계, 한우 농가, 한우 조합"),
    "coop_before": words("조합장, 농협, 농가"),
    "farms": words("농가"),
    "coop_cue": words("조합장, 조합원, 조합 관계자, 지역 조합, 협동조합, 농협, 농가, 축산, 한우, 젖소, 낙농, 가축, 가축시장, 사료, 상호금융, 축산물, 경영난, 경제사업, 금융사업"),
    "association": words("축구협회, 축구협회장"),
    "national_cue": NATIONAL_CUES,
    "subject": words("대한 축구협회, 축구협회, 축협, KFA, 한국 축구, 대한민국 축구"),
    "account": ACCOUNTS,
    "audit_not_thanks": words("감사"),
    "audit": words("감사"),
    "explicit_audit": EXPLICIT_AUDIT,
    "thanks": THANKS,
    "thanks_for": each(words("기회, 응원, 지원, 성원"), ("", "을"), " 주신"),
    "thanked": words("감사, 고맙"),
    "person_matter": words("문체부, 문화체육관광부, 문체위, 국회, 청문회, 전력강화위원회, 감독 선임, 선임 절차, 회장 선거, 선거인단, 정관, 징계, 소송, 가처분, 이사회, 집행부, 후속 조치, 해명, 사퇴, 전력강화위원") + each("선거 ", words("운동, 사무원, 후보, 캠프, 득표, 투표, 대의원, 인단")),
    "coach": words("감독, 사령탑, 홍명보"),
    "coach_after": words("선임, 후보, 후임, 차기, 지원, 관심, 러브콜, 의혹, 수사, 소환, 논란"),
    "coach_before": words("선임, 후보, 후임, 차기, 지원설, 러브콜, 의혹, 수사, 소환, 논란"),
    "coach_out": words("자진, 사퇴, 퇴진, OUT"),
    "leaders": words("정몽규, 허정무, 이임생, 박지성"),
    "leaders_gone": words("떠난, 물러난, 퇴임, 임기, 상임위, 집행위원, 협회장"),
    "candidates": words("정몽규, 허정무"),
    "vote": words("선거"),
    "people": PEOPLE,
    "people_matter": words("임시 감독, 감독 체제, 출연금, 후원, 참관단, 출장비, 비판, 반발, 저격, 막말, 의혹, 논란, 혁신, 개혁, 부회장"),
    "tracked": TRACKED,
    "strong_issue": STRONG_ISSUE_WORDS,
    "audit_context": words("문체부, 문화체육관광부, 대한축구협회, 대한 축구협회, 축구협회 감사, 축구협회 특정 감사, 대표팀 감독, 대표팀 감독 선임, 감독 선임, 전력강화위원회, 한국 축구, 한국축구, 대한민국 축구, 대한민국 대표팀"),
    "home_word": words("대한축구협회, 대한 축구협회, 대한축구협회장, 대한 축구협회장, K-축구혁신위원회, K-축구 혁신위원회, K-축구 혁신위, K-축구 혁신, K축구혁신위, K축구 혁신위, K-혁신위, 축구혁신위, 축구 혁신위원회, 한국 축구, 한국축구, 대한민국 축구, 한국 대표팀, 한국 국가대표, 대한민국 대표팀, 한국프로축구연맹, 프로축구연맹, K리그, 전력강화위원회, 전력강화위원"),
    "home_body": words("대한 축구협회, 대한민국 축구, 대한민국 대표팀, 대한민국 국가대표, 한국 축구, 한국 대표팀, 한국 국가대표, K- 축구 혁신, K 축구 혁신"),
    "korea": words("한국, 대한민국, 韓"),
    "korea_plain": words("한국, 대한민국"),
    "appointed": words("부임, 감독, 사령탑, 후임, 후보, 러브콜, 한국행"),
    "coach_replaced_word": words("홍명보 후임, 홍명보 감독 후임"),
    "successor": words("후임"),
    "hong": words("홍명보"),
    "compared": words("비교, 사례, 참고, 검토, 벤치마킹"),
    "structure": words("카르텔, 인맥, 밀실, 비리, 부패, 거버넌스, 운영 책임, 개혁, 혁신, 구조"),
    "coach_process_word": words("감독 선임, 선임 과정, 차기 감독, 차기 사령탑, 감독 후보, 감독 후임, 사령탑 후보, 사령탑 후임"),
    "resigned": words("자진 사퇴, 사퇴"),
    "sport": SPORTS,
    "sport_long": SPORTS + MORE_SPORTS,
    "sport_word": SPORTS + MORE_SPORTS + each("대한", SPORTS, "협회") + LEAGUES,
    "sport_league": words("프로야구, 메이저리그, 잠실야구장"),
    "league": LEAGUES,
    "sport_body": words("협회, 연맹, 감독, 사령탑") + TEAM,
    "body_word": words("협회, 연맹") + TEAM,
    "sport_team": each(SPORTS, " ", ("", "남자 ", "여자 "), TEAM),
    "head_coach": words("감독, 사령탑"),
    "football_title": words("축구, 대한 축구협회, 축협, <KFA>, 전강위"),
    "football": words("축구, 대한 축구협회, 한국 축구, 대한민국 축구, <KFA>, 전력강화위원, 전강위"),
    "football_word": words("축구, football"),
    "bridge_word": words("국회, 문체위, 청문회, 대한 축구협회, 축협, K- 축구 혁신, K 축구 혁신"),
    "korean_football": words("한국 축구, 대한민국 축구"),
    "reform": words("개혁, 혁신"),
    "impact_subject": words("대한 축구협회, 대한 축구협회장, 축구협회장, <KFA>"),
    "impact": words("영향, 적용, 개선, 개혁, 혁신, 선거, 선출, 투표, 정관, 규정, 직선제, 개편, 발판, 불쏘시개, 수순"),
    "team": words("국가 대표팀, 대표팀"),
    "team_coach_hunt": words("선임, 후보, 차기, 지원, 거론"),
    "next_coach": words("차기 감독, 차기 사령탑, 차기 대표팀 감독, 차기 대표팀 사령탑"),
    "coach_hunt": words("선임, 후보, 지원"),
    "direct": DIRECT,
    "farm_title": words("농협, 농업협동조합, 조합원, 조합장, 축산경제, 농업, 농촌"),
    "local_actor": words("정몽규, 박지성, 이영표, 홍명보, 이임생"),
    "local_act": LOCAL_ACTS,
    "local_actor_more": words("정몽규, 박지성, 이영표, 홍명보, 이임생, 서강일"),
    "local_topic": words("축구협회, 혁신위원회, K- 축구 혁신, K 축구 혁신, 축구 혁신"),
    "club": CLUBS,
    "club_hunt": words("후보, 선임, 부임, 후임, 차기, 거론"),
    "local_contest": words("고등학교, 고교, 중학교, 초등학교, 여성 축구 단, 여자 축구 단, 생활체육, 구청, 시청, 군청, 지역 리그, 권역 리그, 전국대회, 도지사배, 대구/경북, 대구·경북, 충북 축구협회, 충주시 축구협회, 시흥시 축구협회"),
    "contest_result": words("전승, 무패, 우승, 정상, 최강, 최종전, 승리, 대회, 리그"),
    "played": words("월드컵, 본선, 조별리그, 32강, 16강, 탈락, 조기탈락, 경기력, 패배, 참사"),
    "blamed": words("원흉, 책임자로 지목, 레전드들, 슈퍼스타, 외신이 본, 일본 언론, 충격진단, 탓만, 불화, 패자, 전술 문제, 쓴소리, 골 걱정"),
    "officiating": words("심판, 주심, 부심, VAR, 비디오 판독, 판정, 오심, 경기 규칙, 퇴장, 경고"),
    "roster": words("<MLS>, 올스타전, 로스터, 와일드카드, 최종 엔트리, 엔트리, 병역 혜택, 득점왕, 축구인생, 뽈터뷰, 유망주"),
    "politics": words("정청래, 김어준, 김민석, 장성철, 송영길, 민주당, 국민의힘, 당대표, 전당대회, 당무위, 선호투표, 한판승부, 체포방해, 윤석열"),
    "title_subject_word": words("대한 축구협회, 한국 축구, 대한민국 축구, 한국프로축구연맹, 프로축구연맹, K리그, 전강위, 전력강화위원, 감독 선임, 축구 혁신위, K- 축구 혁신, K 축구 혁신, K-혁신위"),
    "team_or_hong": words("대표팀, 국가대표, 홍명보"),
    "coach_seat": words("임시 감독, 감독 체제, 감독 공석, 차기 감독, 감독 후임"),
    "korean_team": each(words("한국, 대한민국"), " 국가대표", ("", "팀")),
    "team_hunt": words("후보, 선임, 차기, 후임"),
    "ministry": words("문체부, 문화체육관광부"),
    "body_any": words("축구협회, 축협"),
    "body_audit": words("특별 감사, 감사 착수, 감사 결과, 감사 발표"),
    "ministry_topic": words("월드컵, 축구, 대표팀, 대한축"),
    "wrongs": words("부조리, 비위, 위법, 파헤, 개혁, 쇄신"),
    "hearing_subject": words("축구, 대표팀, 선수"),
    "hearing": words("청문회"),
    "bundled": words("주요 뉴스, 오늘의 뉴스, 헤드라인, 이슈 종합, 뉴스 Top 10, 세상의 지식"),
    "audit_of_body": words("협회 감사"),
    "audited": words("회장, 관계자, 징계, 자격정지"),
    "was_candidate": words("후보로 거론됐던, 후보로도 거론됐던, 후보였던"),
    "abroad": words("중동행, 해외행, 이적"),
    "in_the_end": words("결국"),
    "left_for": words("선택, 부임, 떠나"),
    "wanted_coach": words("러브콜, 지원, 후보, 후임, 차기, 새 사령탑, 고심"),
    "structure_bridge": words("축구협회, 한국 축구, 대한민국 축구, 축구계"),
    "national_name": words("대한 축구 협회"),
    "lead_matter": words("회장 선거, 선거인단, 정관, 집행부, 개혁, 혁신, 리더십"),
    "hearing_topic": words("손흥민, 황희찬, 태극전사, 축구, 대표팀"),
    "hearing_body": words("대한 축구 협회, 축구협회, <KFA>"),
    "any_body": words("대한 축구 협회, 축구협회, 축협, <KFA>"),
    "direct_subject": words("축협, 대한 축구 협회, 한국 축구, 대한민국 축구"),
    "title_home": words("대한 축구협회, 한국 축구, 대한민국 축구, K리그"),
    "hangul_association": words("축구협회, 축구협회장"),
    "country": COUNTRIES + MORE_COUNTRIES,
    "foreign_noun": each(("", "남자 ", "여자 "), "축구협회") + each(("", "남자 축구 ", "여자 축구 "), words("대표팀, 국가대표, 사령탑, 감독, KFA>")),
    "kfa_noun": each(("", "남자 축구 ", "여자 축구 "), "KFA>"),
    "foreign_letters": words("<DFB>, <JFA>, <FIGC>, <EFA>, <FAI>, <UAEFA>"),
    "tank_corps": words("전차 군단"),
    "local_noun": words("축구협회"),
    "coop_noun": words("축협"),
    # of the classifier
    "domestic_word": DOMESTIC,
    "generic_cue": GENERIC_CUES,
    "signal": SIGNALS,
    "executive_body": words("대한축구협회, 대한 축구협회, 대한축구협회장, 대한 축구협회장, K-축구혁신위원회, 축구혁신위, 박항서, KFA 임원, KFA 이사회, KFA 집행부, KFA 부회장, KFA 전무, KFA 전무이사, KFA 사무총장"),
    "officer": each(words("대한 축구협회, KFA, 축구협회"), " 임원") + each("임원 ", words("회의, 인선, 진, 명단, 구성, 사퇴, 선임, 개편, 동향")),
    "audit_context_word": words("문체부, 문화체육관광부, 대한축구협회, 대한 축구협회, 축구협회 감사, 축구협회 특정 감사, 대표팀 감독 선임, 감독 선임, 전력강화위원회, 한국 축구, 한국축구, 대한민국 축구"),
    "audit_subject": words("대한 축구협회, 한국 축구"),
    # of videos
    "rescue_topic": words("개혁, 혁신, 운영 책임, 책임 구조, 책임 규명, 부패, 비리, 카르텔, 인맥, 감독 선임, 청문회, 회장 선거, 선거인단, 정관, 징계, 수사, 이사회") + each("감사 ", words("착수, 결과, 발표, 보고서, 처분, 지적")),
    "rescue_word": words("전력강화위원, 전력강화위원회"),
    "rescue_association": words("축구협회"),
    "rescue_governance": words("국회, 국회의원, 청문회, 회장 선거, 선거인단, 감독 선임, 전력강화위원, 정관, 이사회, 사퇴, 징계, 가처분, 수사, 고발") + each("감사 ", words("착수, 결과, 발표, 보고서, 처분, 지적")),
    "rescue_excluded": words("감사 합니다, 감사 드립니다, 감사 드려요, 감사 해요, 감사한 마음, 감사한 뜻, 감사한 인사, 감사의 말, 감사의 뜻, 감사의 마음, 감사의 인사, 하이라이트, 골 모음, 경기 장면, 다시 보기, 경기 리뷰"),
}
LITERAL, EXACT = frozenset({"strong_issue", "domestic_word", "executive_body", "audit_context_word"}), frozenset({"tracked", "home_word", "audit_context"})
EITHER = {
    "kfa_near_matter": (("kfa", 55, "kfa_matter"), ("kfa", 55, "kfa_more")),
    "home_override": (("home_team", 45, "home_process"), ("chair_vote", 30, "direct_vote")),
    "national": (("association", 65, "national_cue"),),
    "accounted": (("subject", 50, "account"), ("subject", 50, "audit_not_thanks")),
    "person_near": (("coach", 24, "coach_out"), ("leaders", 35, "leaders_gone"), ("candidates", 40, "vote"), ("people", 45, "people_matter")),
    "korean_coach": (("korea", 30, "appointed"),),
    "other_body_near": (("sport_long", 24, "sport_body"),),
    "other_coach": (("sport_team", 32, "head_coach"),),
    "local_actor_near": (("local_actor", 60, "local_act"),),
    "title_subject_near": (("team_or_hong", 30, "coach_seat"), ("hearing_subject", 24, "hearing")),
    "generic_near": (("association", 55, "generic_cue"),),
    "audit_related_near": (("audit_subject", 50, "audit"), ("ministry", 30, "audit")),
    "rescue_near": (("korean_football", 40, "rescue_topic"),),
    "rescue_association_near": (("rescue_association", 45, "rescue_governance"),),
}
CHAINS = {
    "short_near": (("short", 45, "short_after"), ("short_before", 45, "short")),
    "coop_near": (("coop_before", 20, "short"), ("short", 20, "farms")),
    "thanks_chain": (("thanks_for", 30, "thanked"),),
    "person_coach": (("coach", 24, "coach_after"), ("coach_before", 24, "coach")),
    "coach_replaced_near": (("successor", 24, "hong"),),
    "coach_process_near": (("hong", 30, "resigned"),),
    "bridge_near": (("korean_football", 40, "reform"),),
    "impact_near": (("impact_subject", 100, "impact"),),
    "coach_summary": (("korean_football", 90, "team", 45, "head_coach", 60, "team_coach_hunt"), ("korean_football", 90, "next_coach"), ("korean_football", 90, "head_coach", 35, "coach_hunt")),
    "foreign_club": (("club", 30, "head_coach", 25, "club_hunt"), ("club_hunt", 25, "head_coach", 30, "club")),
    "title_subject_chain": (("korean_team", 25, "head_coach", 20, "team_hunt"), ("team_hunt", 20, "head_coach", 25, "korean_team"), ("ministry", 30, "body_any"), ("body_any", 30, "body_audit"), ("ministry", 45, "ministry_topic"), ("body_any", 30, "wrongs")),
    "audited_chain": (("audit", 35, "audited"),),
    "left_chain": (("in_the_end", 25, "left_for"),),
}
SHAPES = {
    "other_kfa": OTHER_IDENTITY,
    "home_identity": HOME_IDENTITY,
    "listing": r"^\s*\[?(?:오늘의\s*주요일정|오늘의\s*일정|주요일정)",
    "youth_side": r"U-?[0-9]{2}",
    "managing": r"전무\s*(?:이사|직|가|는|를|의|와|및|겸|으로|로|에게|인|도|,|\.|\)|$)",
    "committee": r"(?i)K[-\s]?축구혁신(?:위원회|위)",
    "politics_abroad": r"^미국\s*(?:대통령|대선)",
    "bare_home": r"(?i)^(?:대한\s*축구협회|KFA)$",
}


def _all(c: set[str], *names: str) -> bool:
    return c.issuperset(names)


def _any(c: set[str], *names: str) -> bool:
    return not c.isdisjoint(names)


#: Cues that follow from others, in order.
DERIVED: dict[str, Callable[[set[str]], bool]] = {
    "foreign_body": lambda c: _any(c, "foreign_link", "foreign_letters", "tank_corps"),
    "foreign_team": lambda c: _any(c, "foreign_link", "foreign_letters"),
    "gratitude": lambda c: _any(c, "thanks", "thanks_chain"),
    "coach_replaced": lambda c: _any(c, "coach_replaced_word", "coach_replaced_near"),
    "coach_process": lambda c: _any(c, "coach_process_word", "coach_process_near"),
    "other_body": lambda c: _any(c, "other_body_near", "league"),
    "other_sport": lambda c: _any(c, "sport_word", "sport_league"),
    "bridge": lambda c: _any(c, "bridge_word", "bridge_near"),
    "livestock": lambda c: _any(c, "coop_phrase", "coop_near", "local_coop") or _all(c, "short", "coop_cue"),
    "kfa_context": lambda c: "kfa_near_matter" in c and not _any(c, "other_kfa", "foreign_kfa") and ("other_field" not in c or "home_override" in c),
    "short_context": lambda c: "short_near" in c and "livestock" not in c,
    "national_governance": lambda c: "national" in c and not _any(c, "livestock", "foreign_body") and ("local_body" not in c or "home_name" in c),
    "korean_football_context": lambda c: (not ("foreign_body" in c and not _any(c, "home_body", "kfa_context"))) and _any(c, "home_word", "kfa_context", "short_context", "national_governance", "korean_coach", "coach_replaced"),
    "kfa_compared": lambda c: _all(c, "kfa", "compared") and not _any(c, "foreign_kfa") and "foreign_body" in c,
    "accountable": lambda c: (
        not _any(c, "other_kfa", "livestock")
        and not ("foreign_body" in c and not _any(c, "home_body", "kfa_compared"))
        and not ("gratitude" in c and "explicit_audit" not in c)
        and not _all(c, "kfa", "other_field")
        and (_any(c, "accounted", "national_governance") or _all(c, "kfa_context", "kfa_account"))
    ),
    "association_governance": lambda c: "national_governance" in c or _all(c, "kfa_context", "kfa_cue") or _all(c, "short_context", "short_governance"),
    "home_governance": lambda c: "home_body" in c and _any(c, "national", "kfa_cue"),
    "person_governance": lambda c: _any(c, "person_matter", "person_near", "person_coach") or ("explicit_audit" in c and "gratitude" not in c),
    "strong_audit": lambda c: "audit_context" in c or _all(c, "kfa_context", "explicit_audit"),
    "bare_structure": lambda c: _all(c, "kfa_context", "structure", "football_word"),
    "ministry_audit": lambda c: "ministry" in c and _any(c, "audit_of_body", "audited_chain"),
    "title_subject": lambda c: _any(c, "title_subject_word", "title_subject_near", "title_subject_chain", "korean_coach", "coach_replaced", "kfa_context", "short_context"),
    "contest": lambda c: _any(c, "local_contest", "youth_side") and "contest_result" in c,
    "low_value": lambda c: _all(c, "played", "blamed"),
    "rescued": lambda c: _any(c, "rescue_near", "rescue_word", "committee"),
    # of the classifier
    "domestic": lambda c: _any(c, "domestic_word", "coach_replaced", "kfa_context", "short_context"),
    "audit_meant": lambda c: "explicit_audit" in c or ("audit" in c and not _any(c, "thanks")),
    "audit_related": lambda c: _any(c, "audit_related_near", "kfa_context"),
    "audit_about": lambda c: _any(c, "audit_context_word", "kfa_context"),
}

#: What some of them cannot do without: one of these.
BECAUSE: dict[str, tuple[str, ...]] = {
    "foreign_body": ("foreign_link", "foreign_letters", "tank_corps"),
    "other_body": ("other_body_near", "league"),
    "livestock": ("coop_phrase", "coop_near", "local_coop", "short"),
    "kfa_context": ("kfa_near_matter",),
    "short_context": ("short_near",),
    "national_governance": ("national",),
    "korean_football_context": ("home_word", "kfa_context", "short_context", "national_governance", "korean_coach", "coach_replaced"),
    "coach_replaced": ("coach_replaced_word", "coach_replaced_near"),
    "kfa_compared": ("kfa",),
    "accountable": ("accounted", "national_governance", "kfa_context"),
    "association_governance": ("national_governance", "kfa_context", "short_context"),
    "home_governance": ("home_body",),
    "person_governance": ("person_matter", "person_near", "person_coach", "explicit_audit"),
    "strong_audit": ("audit_context", "kfa_context"),
    "bare_structure": ("kfa_context",),
    "ministry_audit": ("ministry",),
}


def lexicon(localities: tuple[str, ...] = (), districts: tuple[str, ...] = ()) -> Lexicon:
    """The feed's lexicon with the names of places: localities may stand with or without their
    kind before a local body, districts need theirs."""
    hangul, han = r"[가-힣]", r"[ᄀ-ᇿ㄰-㆏가-힣㐀-䶿一-鿿]"
    places = lambda noun: (Link("locality", BETWEEN_PLACE_AND_BODY, noun, hangul), Link("district", BETWEEN_DISTRICT_AND_BODY, noun, hangul))
    links = {
        "foreign_link": (Link("country", BETWEEN_COUNTRY_AND_BODY, "foreign_noun", han),),
        "foreign_kfa": (Link("country", BETWEEN_COUNTRY_AND_BODY, "kfa_noun", han),),
        "local_body": places("local_noun"),
        "local_coop": places("coop_noun"),
    }
    families = FAMILIES | {"home_name": words("대한 축구협회"), "locality": localities, "district": districts}
    return Lexicon(families, CHAINS, EITHER, links, SHAPES, {"audit_not_thanks": words("합니다, 드립니다, 인사, 패, 를전, 전")}, LITERAL, EXACT, DERIVED, BECAUSE, {"other_kfa": "Ff"})


class Football:
    """Reads texts with the feed's lexicon, and cuts them where the subject changes."""

    def __init__(self, localities: tuple[str, ...] = (), districts: tuple[str, ...] = ()):
        self.reader = Reader(lexicon(localities, districts))
        self.cues = lru_cache(maxsize=4_000)(lambda text: Cues(self.reader, text))
        #: The segments of a text; one text of an item is cut for many questions.
        self.segments = lru_cache(maxsize=32)(self._segments)

    def _begins(self, clause: str, before: str) -> bool:
        """Whether a clause is about another sport's body, a foreign one or politics elsewhere, and
        doesn't go on comparing the association with it."""
        c = self.cues(clause)
        if "other_sport" in c and "body_word" in c:
            return True
        goes_on = "bare_home" in self.cues(before.strip()) and ("compared" in c or "대신" in clause)
        return not goes_on and not c.isdisjoint(("foreign_body", "politics_abroad"))

    def _segments(self, text: str) -> Parts:
        cut = segments(re.sub(OTHER_SUBJECT, ". ", text) if "," in text else text)
        return Parts(self.reader, (p for s in cut for p in (clauses(s, self._begins) if "," in s else [s]) if p))


RULES = Rules(
    strong=("대한축구협회", "대한 축구협회", "KFA", "K-축구혁신위원회", "축구혁신위", "한국프로축구연맹", "프로축구연맹"),
    weak=("축구협회", "축구협회장", "축협"),
    high_interest=("해명", "사퇴", "감사", "청문회", "선거인단", "선거운영위원회", "가처분", "재심의", "정관"),
    forbidden_labels=("비리", "범죄", "확정 의혹", "부패", "유착", "문제 인물", "블랙리스트", "논란"),
    labels={"해명": "해명 키워드 포함", "감사": "감사 키워드 포함", "선거인단": "선거 키워드 포함"},
    base_queries=("대한축구협회", "KFA", "K-축구혁신위원회", "축구혁신위", "축구협회 회장 선거", "축구협회 선거인단", "축구협회 정관", "축구협회 감사", "축구협회 해명", "전력강화위원회", "대표팀 감독 선임", "감독 후보"),
    query_prefix="축구협회",
    subject_words=("축구", "kfa", "대표팀", "전력강화위원회"),
)
COACH_ISSUE, OFFICERS_ISSUE, AUDIT_ISSUE = "coach-appointment", "kfa-executives", "mcst-audit"
OFFICERS = frozenset(words("person_chung_mong_gyu, person_lee_yong_soo, person_kim_byung_ji, person_kim_seung_hee, person_hyun_young_min, person_jeon_han_jin, person_lee_im_saeng"))
AUDIT_WORDS = ("문체부 감사", "문화체육관광부 감사")
OFFICER_CUES = {"임원": "officer", "전무": "managing"}
CHAIRS = ("축구협회장", "대한축구협회장")


class FootballClassifier(Classifier):
    """The classifier with the feed's meanings: what a name of the association needs about it,
    which segments count for an issue, and what its ambiguous words stand for."""

    def __init__(self, issues: list[Issue], people: list[Person], localities: tuple[str, ...] = (), districts: tuple[str, ...] = (), rules: Rules = RULES):
        super().__init__(rules, issues, [p for p in people if p.published])
        self.football = Football(localities, districts)

    def cut(self, text: str) -> Parts:
        return self.football.segments(text)

    def _named(self, segment: str, ids: frozenset[str] | None = None) -> bool:
        return any((ids is None or p.id in ids) and self.person_evidence(p, segment, segment) for p in self.people)

    def _generic(self, segment: str) -> bool:
        """Whether the association without its country's name is the national one."""
        c = self.football.cues(segment)
        if "domestic" in c:
            return True
        return "local_body" not in c and ("generic_near" in c or ("signal" in c and self._named(segment)))

    def _organisation(self, word: str, segment: str) -> bool:
        if word == "KFA":
            return not self._rebound and "domestic" in self.football.cues(segment)
        if word == "축협":
            return "short_context" in self.football.cues(segment)
        return word in self.rules.strong or self._generic(segment)

    def means(self, word: str, text: str) -> bool:
        return word != "감사" or "audit_meant" in self.football.cues(text)

    def _counts(self, issue: Issue, segment: str) -> bool:
        coach = issue.id == COACH_ISSUE
        in_context = not issue.context or any(has(segment, w) for w in issue.context)
        if not in_context and not (coach and any(has(segment, w) for p in self.people for w in p.keywords)):
            return False
        if any(has(segment, w) for w in issue.excluded) or not all(any(has(segment, w) for w in group) for group in issue.required):
            return False
        c = self.football.cues(segment)
        if "other_kfa" in c or (self._rebound and "kfa" in c and "home_identity" not in c):
            return False
        if "sport_word" in c and "football" not in c:
            return False
        if coach and ("other_coach" in c or ("foreign_team" in c and "domestic" not in c)):
            return False
        return in_context or "foreign_team" not in c

    def _shows(self, issue: Issue, word: str, segment: str) -> bool:
        if not has(segment, word):  # what is asked of cues below holds only with the word
            return False
        if issue.id == OFFICERS_ISSUE:
            return word not in OFFICER_CUES or OFFICER_CUES[word] in self.football.cues(segment)
        if issue.id == AUDIT_ISSUE or any(w in AUDIT_WORDS for w in issue.keywords):
            needs = ("audit_meant", "audit_related") if "감사" in word else ("audit_about",) if word == "조사 결과" else ()
            return not needs or self.football.cues(segment).issuperset(needs)
        return word not in CHAIRS or self._generic(segment)

    def issue_evidence(self, issue: Issue, parts: list[str]) -> list[str]:
        if issue.id == COACH_ISSUE:
            whole = self.football.cues(self._whole)
            if "foreign_team" in whole and "domestic" not in whole:
                return []
            if self._title:  # dots don't part a headline on coaches
                parts = self.cut(re.sub(r"\.{2,}|…+", " ", self._text))
        every = distinct([*issue.keywords, *(w for group in issue.required for w in group)])
        held = {w for w in every if any(self._shows(issue, w, s) and self._counts(issue, s) for s in parts)}
        if held and issue.id == OFFICERS_ISSUE and not any("executive_body" in self.football.cues(s) or self._named(s, OFFICERS) for s in parts if self._counts(issue, s)):
            return []
        return [w for w in every if w in held]

    def both(self, title: str, summary: str) -> tuple[Field, Field]:
        self._whole = f"{title} {summary}".strip()
        c = self.football.cues(self._whole)
        self._rebound = "other_kfa" in c and "home_identity" not in c
        out = []
        for self._title, self._text in ((True, title), (False, summary)):
            out.append(self.field(self._text))
        first, head = out[0], self.football.cues(title)
        if "축구협회장" in title and not {"local_body", "livestock"} & head and any({"domestic", "signal"} <= self.football.cues(s) for s in self.cut(summary)):
            first.organisations, first.keywords = distinct([*first.organisations, "축구협회장"]), distinct([*first.keywords, "축구협회장"])
        return out[0], out[1]


def gazetteer(names: DataFrame, most: int = 100_000) -> tuple[str, ...]:
    """The names in the one column of `names`, distinct and sorted, for an automaton in each worker; more than
    `most` are refused.  A name takes a node a syllable at most: 100,000 some 30 MB."""
    column = names.columns[0]
    rows = names.where(F.trim(column) != "").select(F.trim(column).alias("name")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} names")
    return tuple(sorted(r["name"] for r in rows))
