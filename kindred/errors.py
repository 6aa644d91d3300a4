"""Errors carry the code that the response envelope reports."""

from __future__ import annotations

import re
from typing import Any

SUCCESS, BAD_REQUEST, INTERNAL, UNAVAILABLE = 200, 400, 500, 503

# Messages that callers compare with.
MSG_PARAGRAPH_EMPTY = "合同段落不能为空"
MSG_PARAGRAPH_LONG = "合同段落不能超过{limit}字符"
MSG_CODES_EMPTY = "变更类型编码不能为空"
MSG_CODE_LONG = "单个变更类型编码不能超过64字符"
MSG_CODE_SPACE = "变更类型编码不能包含空白字符: "
MSG_CODES_LONG = "变更类型编码总长度不能超过4000字符"
MSG_HEADER = "表头必须为：合同段落、变更类型编码"
MSG_ROW_CAP = "单次导入不能超过{limit}条"
MSG_FILE_CONFLICT = "Excel中存在相同段落但变更类型编码不同，首次出现在第{row}行"
MSG_STORE_CONFLICT = "数据库已存在相同段落，但变更类型编码不同"
MSG_QUERY_DIMENSION = "查询向量维度不正确"
MSG_FILE_EMPTY = "Excel文件不能为空"
MSG_FILE_TYPE = "只支持xlsx格式文件"
MSG_FILE_BROKEN = "Excel读取失败，请确认文件未损坏且格式为xlsx"
MSG_NO_SHEET = "Excel中没有工作表"
HEADER_PARAGRAPH, HEADER_CODES = "合同段落", "变更类型编码"


class EngineError(Exception):
    """A failure that the caller can act on."""

    def __init__(self, message: str, code: int = BAD_REQUEST):
        super().__init__(message)
        self.code = code


#: How an error of a Python worker or of a plan shows its code to the driver, where only its text arrives.
MARK = "engine-error"
_MARKED = re.compile(rf"{MARK} (\d{{3}}): (.*?)(?: SQLSTATE: \w+)?\s*$", re.M)


def marked(error: EngineError) -> EngineError:
    """The error as a worker must raise it, so that raised_by_worker() finds it again."""
    return error if _MARKED.search(str(error)) else EngineError(f"{MARK} {error.code}: {error}", error.code)


def raised_by_worker(error: BaseException) -> EngineError | None:
    """The EngineError behind a failure: itself, or the one that made a Spark job fail, by the text of Spark's exception."""
    if isinstance(error, EngineError):
        return error
    texts, java = [str(error)], getattr(error, "_origin", None) or getattr(error, "java_exception", None)
    while java is not None:
        texts.append(java.toString())
        java = java.getCause()
    found = next(filter(None, map(_MARKED.search, texts)), None)
    return EngineError(found[2].strip(), int(found[1])) if found else None


def envelope(call, *args, **kwargs) -> dict[str, Any]:
    """Run an API call and wrap what it gives, or its error, as code, message and data."""
    try:
        return {"code": SUCCESS, "message": "success", "data": call(*args, **kwargs)}
    except Exception as e:
        known = raised_by_worker(e)
        return {"code": known.code if known else INTERNAL, "message": str(known or "internal error"), "data": None}
