"""JSON keys that carry nothing for a reader, by the tool that wrote the JSON."""

from __future__ import annotations

#: Fixed values.
PROFILES: dict[str, frozenset[str]] = {
    "passthrough": frozenset(),
    "k8s": frozenset({
        "managedFields", "resourceVersion", "uid", "generation", "creationTimestamp", "selfLink",
        "ownerReferences", "finalizers", "annotations", "labels", "lastTransitionTime",
    }),
    "postgres": frozenset({
        "pid", "backend_start", "query_start", "xact_start", "state_change", "application_name",
        "client_addr", "client_hostname", "client_port", "backend_xid", "backend_xmin", "leader_pid",
    }),
    "azure": frozenset({"systemData", "etag", "provisioningState", "id", "managedBy", "kind"}),
}


def profile(name: str) -> frozenset[str]:
    """An unknown name denies nothing."""
    return PROFILES.get(name, PROFILES["passthrough"])
