"""Image files sent to a recogniser: a data source whose partitions read files, call a client and yield one row for each.

The client is a function that takes the request's JSON and returns (HTTP status, response text). A service's client, with its
address and key, belongs to the caller; tests hand in a recorded one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

Client = Callable[[str], tuple[int, str]]

#: Calls for one image, and files read by one task.
TRIES, FILES = 3, 64
#: What is asked of the recogniser, and the statuses after which it is asked again.
FEATURE, HINT, AGAIN = "DOCUMENT_TEXT_DETECTION", "en", (429, 500, 502, 503, 504)
#: ``response`` is null unless ``status`` is 200; ``reason`` is "ok" or why there is nothing to read.
ROWS = "image_id long, path string, status int, tries int, response string, reason string"


def recogniser_source(client: Client, tries: int = TRIES, files: int = FILES) -> type:
    """The data source "recogniser" around ``client``; the classes are made here so that it travels with them."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    schema, feature, hint, again = ROWS, FEATURE, HINT, AGAIN

    class Some(InputPartition):
        def __init__(self, first: int, paths: list[str]):
            super().__init__(first)
            self.first, self.paths = first, paths

    def reason(status: int, text: str) -> str:
        import json

        if not 200 <= status < 300:
            return f"status {status}"
        try:
            note = json.loads(text)["responses"][0].get("fullTextAnnotation")
        except (ValueError, LookupError, AttributeError, TypeError):
            return "broken"
        return "no annotation" if note is None else "no pages" if not note.get("pages") else "ok"

    class Reader(DataSourceReader):
        def __init__(self, folder: str):
            self.folder = folder

        def partitions(self) -> list[Some]:
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(self.folder)
            found = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file)
            return [Some(k, found[k : k + files]) for k in range(0, len(found), files)]

        def read(self, partition: Some) -> Iterator[tuple]:
            import base64
            import json

            from pyarrow import fs

            store, _ = fs.FileSystem.from_uri(self.folder)
            for k, path in enumerate(partition.paths):
                with store.open_input_stream(path) as data:
                    content = base64.b64encode(data.read()).decode()
                request = json.dumps({"requests": [{"image": {"content": content}, "features": [{"type": feature, "maxResults": 1}], "imageContext": {"languageHints": [hint]}}]})
                for turn in range(1, tries + 1):
                    try:
                        status, text = client(request)
                    except OSError:
                        status, text = 503, ""
                    if status not in again:
                        break
                good = 200 <= status < 300
                yield partition.first + k, path, status, turn, text if good else None, reason(status, text)

    class Recogniser(DataSource):
        @classmethod
        def name(cls) -> str:
            return "recogniser"

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> Reader:
            return Reader(self.options["path"])

    return Recogniser


def recognised(spark: SparkSession, folder: str, client: Client, tries: int = TRIES, files: int = FILES) -> DataFrame:
    """(image_id, path, status, tries, response, reason) for every file under ``folder`` (a URI), in the order of paths.

    A call that ends in a status worth another try, or in no connection, is made up to ``tries`` times; what fails then is a row with its reason.
    """
    spark.dataSource.register(recogniser_source(client, tries, files))
    return spark.read.format("recogniser").option("path", folder).load()
