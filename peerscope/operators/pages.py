"""Pages as rows: documents read page by page, each page in a child process with a time limit.

A table function turns a file's content into rows ``extractor, page_no, text,
error`` and is joined laterally to the files. The pages are read in a child
process of the task. A page that does not answer within the limit costs its
limit: the child is killed, also in the middle of native code, and a new one
goes on with the next page. Pages that raise, or take their process down, are
rows with their error.

Stages are tried in order until one gives text. A stage that is not tolerant
is given up at its first failed page; a tolerant one goes on with the others.
A file that no stage could read has one row with the reason and no page.
"""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from peerscope.operators.extract import concat_pages
from peerscope.session import write_table

# content -> pages; the text of a page is made when it is asked for
Reader = Callable[[bytes], Sequence[str]]

PAGE_ROWS = "extractor string, page_no int, text string, error string"


class PageStage(NamedTuple):
    name: str
    reader: Reader
    tolerant: bool = True
    timeout_s: float | None = 30.0


class PageLimit(Exception):
    """A page that did not answer in time, or whose process died."""


def _serve(pipe, reader: Reader, content: bytes) -> None:
    """The child: opens the document, then answers page numbers with (ok, text or error)."""
    def answer(make):
        try:
            pipe.send((True, make()))
        except Exception as e:  # noqa: BLE001 - a failed page is a row with its error
            pipe.send((False, f"{type(e).__name__}: {e}"))

    opened: list[Sequence[str]] = []

    def open_document():
        opened.append(reader(content))
        return len(opened[0])

    answer(open_document)
    while opened:
        try:
            number = pipe.recv()
        except EOFError:
            return
        answer(lambda: opened[0][number])


class PageProcess:
    """One document in a child process that is started anew when it had to be killed."""

    def __init__(self, stage: PageStage, content: bytes):
        self.stage, self.content, self.child, self.pipe = stage, content, None, None

    def _wait(self):
        ready = self.pipe.poll(self.stage.timeout_s)
        try:
            if ready:
                return self.pipe.recv()
        except EOFError:
            self.close()
            raise PageLimit("process died") from None
        self.close()
        raise PageLimit("timeout")

    def open(self) -> int:
        """The number of pages."""
        context = multiprocessing.get_context("fork")
        self.pipe, theirs = context.Pipe()
        self.child = context.Process(target=_serve, args=(theirs, self.stage.reader, self.content), daemon=True)
        self.child.start()
        theirs.close()
        ok, found = self._wait()
        if not ok:
            self.close()
            raise ValueError(found)
        return found

    def page(self, number: int) -> tuple[bool, str]:
        if self.child is None:
            self.open()
        self.pipe.send(number)
        return self._wait()

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


def read_pages(content: bytes, stage: PageStage) -> tuple[list[tuple[int, str | None, str | None]], str | None]:
    """([(page_no, text, error)], reason): the pages of a document, and why the stage was given up, if it was."""
    rows: list[tuple[int, str | None, str | None]] = []
    document = PageProcess(stage, content)
    try:
        pages = document.open()
        if not pages:
            return [], "no_pages"
        for number in range(pages):
            try:
                ok, text = document.page(number)
            except (PageLimit, ValueError) as e:
                ok, text = False, str(e)
            rows.append((number, text if ok else None, None if ok else text))
            if not ok and not stage.tolerant:
                return rows, f"page {number}: {text}"
        return rows, None
    except (PageLimit, ValueError) as e:
        return rows, str(e)
    finally:
        document.close()


def page_function(stages: Sequence[PageStage]):
    """The table function (content) -> rows of PAGE_ROWS."""
    stages = list(stages)

    class Pages:
        def eval(self, content: bytes) -> Iterator[tuple]:
            reason = "no_content" if content is None else "no_text"
            for stage in stages if content is not None else ():
                rows, given_up = read_pages(bytes(content), stage)
                if given_up is None and any(t and t.strip() for _, t, _ in rows):
                    for number, text, error in rows:
                        yield stage.name, number, text, error
                    return
                reason = f"{stage.name}: {given_up}" if given_up else reason
            yield None, None, None, reason

    return udtf(Pages, returnType=PAGE_ROWS)


def page_rows(files: DataFrame, stages: Sequence[PageStage], key_cols: Sequence[str], content_col: str = "content") -> DataFrame:
    """(keys, extractor, page_no, text, error): the pages of every file; a file without any has one row."""
    found = files.lateralJoin(page_function(stages)(F.col(content_col).outer()))
    return found.select(*key_cols, "extractor", "page_no", "text", "error")


def extract_files(files: DataFrame, stages: Sequence[PageStage], key_col: str = "full_path",
                  content_col: str = "content", on_page_error: str = "skip") -> tuple[DataFrame, DataFrame]:
    """(documents, pages): texts joined from pages, and the page rows they come from.

    ``documents``: (key, raw_text, extractor, status, n_pages, n_failed);
    ``status`` is ``ok`` or the reason, then ``raw_text`` is ''. With
    ``on_page_error='fail'`` a document with a failed page has the status ``failed_page``.
    """
    pages = write_table(page_rows(files, stages, [key_col], content_col), "pages")  # read once, whatever uses them
    texts = concat_pages(pages.where(F.col("page_no").isNotNull()), key_col, "page_no", "text", "error", on_page_error)
    facts = pages.groupBy(key_col).agg(
        F.max("extractor").alias("extractor"), F.count("page_no").cast("int").alias("n_all"),
        F.count_if(F.col("page_no").isNotNull() & F.col("error").isNotNull()).cast("int").alias("n_failed"),
        F.max(F.when(F.col("page_no").isNull(), F.col("error"))).alias("reason"))
    joined = facts.join(texts.select(key_col, "text"), key_col, "left")
    status = (F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("text").isNull(), "failed_page").otherwise("ok"))
    return joined.select(key_col, F.when(status == "ok", F.col("text")).otherwise("").alias("raw_text"),
                         F.when(status == "ok", F.col("extractor")).alias("extractor"), status.alias("status"),
                         F.col("n_all").alias("n_pages"), "n_failed"), pages


# -- readers ---------------------------------------------------------------


def text_pages(content: bytes) -> list[str]:
    """Plain UTF-8 text, pages parted by form feeds."""
    return content.decode("utf-8").split("\f")


class _Lazy(Sequence):
    def __init__(self, n: int, page: Callable[[int], str]):
        self.n, self.page = n, page

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i):
        return self.page(i)


def pdf_pages(content: bytes) -> Sequence[str]:
    """The text layer of a PDF (needs PyMuPDF); an encrypted file has no pages to read."""
    import fitz
    document = fitz.open(stream=content, filetype="pdf")
    if document.is_encrypted:
        raise ValueError("encrypted")
    return _Lazy(len(document), lambda i: document[i].get_text())


def ocr_pages(content: bytes, lang: str = "eng") -> Sequence[str]:
    """Recognised text of the page images of a PDF (needs pdf2image and pytesseract)."""
    import pdf2image
    import pytesseract
    n = pdf2image.pdfinfo_from_bytes(content)["Pages"]

    def page(i: int) -> str:
        image = pdf2image.convert_from_bytes(content, first_page=i + 1, last_page=i + 1)[0]
        return pytesseract.image_to_string(image, lang=lang)

    return _Lazy(n, page)
