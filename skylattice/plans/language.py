"""Documents in a language: codes and phrases at any depth become texts of a table (language, code, text); keys stay.

A text may name the numbers beside its code, as in ``{n} times repeat``: they come from the object that the code stands in.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of our own by code or phrase: (English, Korean).
TEXTS = {
    "empty_csv": ("The file has no rows", "파일에 데이터 행이 없음"),
    "short_log": ("The log has only {n} rows", "로그가 {n}행으로 짧음"),
    "duplicate_columns": ("{n} column names repeat", "이름이 겹치는 열 {n}개"),
    "constant_columns": ("{n} columns never change", "값이 변하지 않는 열 {n}개"),
    "missing_values": ("{n} values are missing", "빠진 값 {n}개"),
    "missing_timestamp": ("There is no time column", "시간 열이 없음"),
    "invalid_timestamp": ("{n} times are missing or invalid", "읽을 수 없는 시각 {n}개"),
    "duplicate_timestamp": ("{n} times repeat", "반복된 시각 {n}개"),
    "reverse_timestamp": ("Times run backwards {n} times", "시각이 거꾸로 간 곳 {n}개"),
    "timestamp_gap_spikes": ("There are {n} large gaps in time", "큰 시간 공백 {n}개"),
    "infinite_values": ("{n} values are infinite", "무한대 값 {n}개"),
    "missing_ekf": ("There is no altitude estimate", "추정 고도가 없음"),
    "missing_reference_altitude": ("There is no reference altitude", "기준 고도가 없음"),
    "missing_motors": ("Motor outputs are missing", "모터 출력이 빠져 있음"),
    "no_armed_segment": ("The vehicle is never armed", "시동 구간이 없음"),
    "no_althold_active_segment": ("Altitude hold is never active", "고도 유지 구간이 없음"),
    "no_timestamp": ("Without times there are no dynamic measures", "시각이 없어 동적 지표를 구할 수 없음"),
    "too_few_rows": ("Too few rows for step responses", "스텝 응답을 보기에는 행이 부족함"),
    "times_not_increasing": ("Times must be finite and increase", "시각이 유한하고 증가해야 함"),
    "no_step": ("No step between clear plateaus", "뚜렷한 평탄 구간 사이의 스텝이 없음"),
    "below_10_percent": ("The response never reaches 10 percent", "응답이 10%에 이르지 못함"),
    "below_90_percent": ("The response never reaches 90 percent", "응답이 90%에 이르지 못함"),
    "not_settled": ("The response never settles", "응답이 안정되지 않음"),
    "too_few_samples": ("Too few common samples", "함께 쓸 수 있는 표본이 부족함"),
    "no_interval": ("The sampling interval is not known", "표본 간격을 알 수 없음"),
    "segment_too_short": ("The common stretch is too short", "공통 구간이 너무 짧음"),
    "flat_signal": ("A signal hardly changes", "신호가 거의 변하지 않음"),
    "no_candidate": ("No lag has enough pairs", "쌍이 충분한 지연이 없음"),
    "at_boundary": ("The best lag lies at the end of the search", "최적 지연이 탐색 범위 끝에 있음"),
    "sign_mismatch": ("The signals are rather opposite", "두 신호의 부호가 반대로 보임"),
    "weak": ("The correlation is weak", "상관이 약함"),
    "ambiguous": ("Another lag fits about as well", "비슷하게 맞는 지연이 또 있음"),
    "small_overlap": ("Too few pairs overlap", "겹치는 쌍이 부족함"),
    "pressure, propeller wash and mounting affect a barometer": ("Pressure, propeller wash and mounting affect a barometer", "기압계는 기압, 프로펠러 바람, 설치 위치에 민감함"),
    "datum and satellite visibility affect a GNSS altitude": ("Datum and satellite visibility affect a GNSS altitude", "위성 고도는 기준면과 위성 가시성에 민감함"),
    "check the sensor type and the datum of the reference": ("Check the sensor type and the datum of the reference", "기준 고도의 센서 종류와 기준면을 확인할 것"),
    "mean correction": ("mean correction", "평균 보정"), "steady error": ("steady error", "정상 상태 오차"), "error spread": ("error spread", "오차 산포"), "oscillation peak": ("oscillation peak", "진동 정점"),
    "saturation": ("saturation", "포화"), "slow oscillation": ("slow oscillation", "느린 진동"), "continuous saturation": ("continuous saturation", "연속 포화"), "slow settling": ("slow settling", "느린 안정"),
    "difference spread": ("difference spread", "차이의 산포"), "motor correlation": ("motor correlation", "모터 상관"), "fast peak": ("fast peak", "빠른 정점"), "mean bias": ("mean bias", "평균 편차"), "lasting bias": ("lasting bias", "지속 편차"),
    "lag": ("lag", "지연"), "lag correlation": ("lag correlation", "지연 상관"), "jitter": ("jitter", "지터"), "dropouts": ("dropouts", "누락"), "duplicate times": ("duplicate times", "반복된 시각"), "reversed times": ("reversed times", "역행한 시각"),
    "motor spread": ("motor spread", "모터 간 차이"), "motor variation": ("motor variation", "모터 변동"), "met": ("met", "충족"), "unmet": ("unmet", "불충족"), "not computable": ("not computable", "계산 불가"),
}
LANGUAGES = ("en", "ko")
#: Fields whose strings are names, not texts.
NAMES = ("hypothesis", "severity", "flight_phase", "reference_altitude_source", "parameter_mapping", "missing_parameters", "schema_version", "direction", "motor", "missing")


def texts(spark: SparkSession) -> DataFrame:
    """Our own texts as rows (language, code, text); a caller may add languages or replace texts by rows of the same kind."""
    return spark.createDataFrame([(language, code, said[k]) for k, language in enumerate(LANGUAGES) for code, said in TEXTS.items()], "language string, code string, text string")


def spoken(value, said: dict[str, str], beside: dict | None = None):
    """A JSON value with its texts replaced; keys and the strings of ``NAMES`` stay."""
    if isinstance(value, dict):
        return {k: v if k in NAMES else spoken(v, said, value) for k, v in value.items()}
    if isinstance(value, list):
        return [spoken(v, said, beside) for v in value]
    if isinstance(value, str) and value in said:
        return said[value].format_map({k: v for k, v in (beside or {}).items() if not isinstance(v, (dict, list))})
    return value


def localised(documents: DataFrame, table: DataFrame, language: str, column: str = "document") -> DataFrame:
    """``documents`` with the JSON texts of ``column`` in a language of ``table`` (language, code, text); the table is joined as one row a language.

    Codes that the language lacks stay as they are; null documents stay null; a language without any text is an error before anything runs.
    """
    if not table.filter(F.col("language") == language).limit(1).count():
        raise ValueError(f"no texts in {language}")
    spoken_in = table.dropDuplicates(["language", "code"]).groupBy("language").agg(F.map_from_entries(F.collect_list(F.struct("code", "text"))).alias("said"))
    names = documents.columns
    at = names.index(column)
    plain = documents.toDF(*[f"c{k}" for k in range(len(names))]).withColumn("language", F.lit(language)).join(spoken_in, "language").drop("language")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields if f.name != "said")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            said = dict(batch.column("said")[0].as_py())  # one language, so one table
            told = [None if d is None else json.dumps(spoken(json.loads(d), said), ensure_ascii=False) for d in batch.column(f"c{at}").to_pylist()]
            columns = [pa.array(told, pa.string()) if k == at else batch.column(f"c{k}") for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(names))])

    return plain.mapInArrow(run, kinds).toDF(*names)
