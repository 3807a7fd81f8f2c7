"""Small files and folders by Spark's own file systems, wherever the path lies (local, HDFS, object stores)."""
from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def names(spark: SparkSession, folder: str, folders: bool = False) -> list[str]:
    """The names in a folder, sorted; none where there is no folder.  folders: those of folders only."""
    fs, place = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place) if not folders or s.isDirectory()) if fs.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _fs(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file with this text, whole or not at all; False where it is there already.

    The text goes to a name of its own first.  Where the file system can link (or rename without replacing), the name is taken in one step, so that of two
    writers one gets it; readers never see half a file."""
    import uuid
    fs, place = _fs(spark, path)
    if fs.exists(place):
        return False
    jvm = spark._jvm
    own = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.getScheme() == "file":  # its rename replaces; a hard link doesn't
        files, java_path = jvm.java.nio.file.Files, jvm.java.nio.file.Path
        try:
            files.createLink(java_path.of(fs.makeQualified(place).toUri()), java_path.of(fs.makeQualified(own).toUri()))
            done = True
        except Exception as e:  # noqa: BLE001 - a Java exception; only this one says that the name is taken
            if "FileAlreadyExistsException" not in str(e):
                raise
            done = False
        fs.delete(own, False)
        return done
    done = fs.rename(own, place)  # HDFS refuses a name that is taken
    if not done:
        fs.delete(own, False)
    return bool(done)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing happens where there is none."""
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder of this process's own to a name that nobody else uses."""
    fs, place = _fs(spark, source)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(to.getParent())
    if not fs.rename(place, to):
        raise OSError(f"{source} could not be renamed to {target}")
