"""Names and labels the telemetry and its reports agree on."""

# Attribute keys, discriminators and metric names of the input,
# and the labels and texts of the reports. They must stay exactly as they are.
RUNTIME_KEY = "k8s.namespace.name"
COMPONENT_KEY = "name"

LOG = "LOG"
METRIC = "METRIC"
ERROR = "ERROR"

RUN_STATUS = "processor.run.status.running"
QUEUED_DURATION = "connection.queued.duration.max"
QUEUED_BYTES = "connection.queued.bytes"

USER_PREFIX = "runtime-"
USER_CREATED = "User Created"
INTERNAL = "Internal"
ACTIVE = "🟢 Active"
INACTIVE = "🔴 Inactive"

WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")

HIGH_ERROR_FINDING = {
    "type": "error",
    "icon": "🔥",
    "title": "High Error Rate Detected",
    "text": "Runtime **%s** has produced **%d errors** in the last {minutes} minutes.",
    "action": "Navigate to the **Root Cause Analysis** tab and select this runtime to investigate.",
    "urgency": "High (Investigate Now)",
}
STOPPED_FINDING = {
    "type": "warning",
    "icon": "🛑",
    "title": "Stopped Processors Found",
    "text": "Runtime **%s** has **%d processor(s)** in a stopped state.",
    "action": (
        "Verify if this is intentional. If not, check the runtime's flow "
        "configuration to restart the processor(s)."
    ),
    "urgency": "Medium (Review Soon)",
}
