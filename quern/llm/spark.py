"""Small Spark helpers of the operators."""

from quern.sources.durable import beside, bounded, by_key, delete, dropped, new_path, octets, put_bytes, shared_folder, tasks, written

__all__ = ["beside", "bounded", "by_key", "delete", "dropped", "new_path", "octets", "put_bytes", "shared_folder", "tasks", "written"]
