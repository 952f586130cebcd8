"""Display labels for task and notification states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels shown for each task state.
TASK_LABELS = {
    "Completed": "✓ Completado",
    "Failed": "✗ Fallido",
    "Running": "▶ En Ejecución",
    "Pending": "⏳ Pendiente",
    "Cancelled": "⊗ Cancelado",
}

# The labels shown for each notification state.
NOTIFICATION_LABELS = {
    "Success": "Enviado",
    "Failed": "Fallido",
    "Retrying": "Reintentando",
}


def _label(status: Column, labels: dict[str, str]) -> Column:
    pairs = [F.when(status == key, text) for key, text in labels.items()]
    return F.coalesce(*pairs, status)


def status_display(status: Column) -> Column:
    """Label of a task state; an unknown state shows as itself."""
    return _label(status, TASK_LABELS)


def notification_display(status: Column) -> Column:
    """Label of a notification state; an unknown state shows as itself."""
    return _label(status, NOTIFICATION_LABELS)
