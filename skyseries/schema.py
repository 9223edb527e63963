"""Schemas of the stored tables and of the message sources."""

LOCATION = "struct<lat: float, lon: float, hamsl: float, hag: float>"

MESSAGES = "message_seq BIGINT, msg STRING"
QC_MESSAGES = "message_seq BIGINT, value STRING"

PARAMS = "id INT, param_code STRING, element_id STRING, is_scalar BOOLEAN"
PARAM_PERMITS = "station_id INT, type_id INT, param_id INT, permit_id INT, ord INT"
STATION_PERMITS = "station_id INT, permit_id INT"

# One row per series; `timeseries`, `labels_met` and `labels_source` are projections of it.
REGISTRY = (
    "timeseries BIGINT, station_id INT, type_id INT, param_code STRING, param_id INT, lvl INT, sensor INT, "
    f"fromtime TIMESTAMP, totime TIMESTAMP, loc {LOCATION}, deactivated BOOLEAN, batch BIGINT"
)

# The three value logs hold at most one row per key and batch; `arrival`, the batch a write came with, orders the writes.
_PLACE = "batch BIGINT, obs_bucket INT, obs_month INT"
DATA = f"timeseries BIGINT, obstime TIMESTAMP, obsvalue FLOAT, arrival BIGINT, {_PLACE}"
NONSCALAR_DATA = f"timeseries BIGINT, obstime TIMESTAMP, obsvalue STRING, arrival BIGINT, {_PLACE}"
# The newest value of every series of a batch.
NEWEST = "timeseries BIGINT, obstime TIMESTAMP, obsvalue FLOAT, arrival BIGINT, batch BIGINT"
QC_PAYLOAD = "original FLOAT, corrected FLOAT, controlinfo STRING, useinfo STRING, cfailed INT"
QC_FLAGS = f"timeseries BIGINT, obstime TIMESTAMP, {QC_PAYLOAD}, arrival BIGINT, {_PLACE}"

QC_RECORD = (
    "message_seq BIGINT, doc_pos ARRAY<INT>, station_id INT, param_id INT, type_id INT, sensor INT, lvl INT, "
    f"obstime TIMESTAMP, {QC_PAYLOAD}"
)
REJECTS = "message_seq BIGINT, code STRING, detail STRING, row_no INT, col_no INT, retry BOOLEAN, batch BIGINT"
RECEIPTS = "message_seq BIGINT, message STRING, message_id BIGINT, res INT, retry BOOLEAN, batch BIGINT"
QUARANTINE = f"{QC_RECORD}, arrival BIGINT, batch BIGINT"
# The newest registry batch that a control batch has seen.
QC_STATE = "registry_batch BIGINT, batch BIGINT"
