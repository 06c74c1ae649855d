"""Fixed values.

These are the limits, formats and user-facing texts of the original
desktop tool. They must stay exactly as written for results to match; they
are listed here together, in their natural order, and nowhere else.
"""

# --- fixed values: limits -------------------------------------------------
MAX_FILE_BYTES = 10 * 1024 * 1024          # largest change-set file accepted
MAX_ROWS = 100000                          # most data rows in one change set
PREVIEW_ROWS = 50                          # rows shown by a preview
STAGED_TEXT_MAX = 4000                     # longest staged text value
WIDTH_PAD = 2                              # export column width padding
WIDTH_CAP = 50                             # export column width cap
HISTORY_LIMIT = 100                        # rows in audit / history views
FIRST_DATA_ROW = 2                         # sheet row of the first data row

# --- fixed values: names and formats --------------------------------------
BACKUP_INFIX = "_BAK_"
STAGING_PREFIX = "TEMP_UPDATE_"
NAME_TS_FORMAT = "yyyyMMdd_HHmmss"         # backup / staging name stamp
TEXT_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"     # audit, history, failed records
ID_TS_FORMAT = "yyyyMMddHHmmssSSSSSS"      # history record id

# --- fixed values: row failure reasons ------------------------------------
REASON_TYPE_MISMATCH = "数据类型不匹配"
REASON_NULL_NOT_ALLOWED = "无法设置为NULL（列可能不允许NULL）"
REASON_ZERO_ROWS = "更新后影响行数为0"

# --- fixed values: history view -------------------------------------------
STATUS_SUCCESS = "成功"
STATUS_PARTIAL = "部分失败"
MISSING_TEXT = "--"
MISSING_COUNT = "0"

# --- fixed values: exports and empty views ---------------------------------
LOG_EXPORT_HEADERS = ("时间", "级别", "消息")      # time, level, message
EXPORT_SHEET = "Sheet1"                         # sheet of exported records
LOG_SHEET = "更新日志"                             # sheet of an exported log
LOG_WIDTH = 40                                  # width of each of its columns
EXPORT_HEADER_FILL = "4472C4"                   # header cells: fill and text colour
EXPORT_HEADER_TEXT = "FFFFFF"
SHEET_ROWS = 1048576                            # rows of a sheet, by the format
NO_RECORDS = "无记录"                            # status text of the empty-history row

# --- fixed values: audit action types --------------------------------------
ACTION_CONNECTION = "CONNECTION"
ACTION_UPDATE = "UPDATE"
ACTION_EXPORT = "EXPORT"
ACTION_ROLLBACK = "ROLLBACK"

# --- fixed values: error code -> message, per stage, first hit wins --------
# (stage, code, label, append the raw message after the label)
ERROR_LABELS = [
    ("update", "ORA-01722", "数据类型不匹配", False),
    ("update", "ORA-01407", "无法设置为NULL（列可能不允许NULL）", False),
    ("sql", "ORA-00942", "表或视图不存在: ", True),
    ("sql", "ORA-00904", "列名无效: ", True),
    ("sql", "ORA-01722", "数据类型不匹配: ", True),
    ("sql", "ORA-00001", "违反唯一约束: ", True),
    ("sql", "ORA-02292", "违反外键约束: ", True),
    ("keys", "ORA-00942", "表或视图不存在: ", True),
    ("keys", "ORA-00904", "列名无效: ", True),
    ("connect", "ORA-12541", "连接失败: TNS无监听程序，请检查主机地址和端口", False),
    ("connect", "ORA-12514", "连接失败: TNS监听程序无法识别服务名，请检查服务名", False),
    ("connect", "ORA-01017", "连接失败: 用户名或密码无效", False),
    ("connect", "ORA-12154", "连接失败: 无法解析服务名，请检查服务名配置", False),
]
# label used when no code of the stage matches; None keeps the raw message
ERROR_FALLBACK = {
    "update": (None, False),
    "sql": ("数据库错误: ", True),
    "keys": ("查询失败: ", True),
    "connect": ("连接失败: ", True),
}
