"""What the names of files and packages say: languages, kinds of references, test files, scopes of dependencies."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename, bound

# Extensions of each language, asset texts, manifests, and packages that come with a platform.
EXTENSIONS = {
    "zig": ("zig",),
    "c": ("c", "h", "cc", "cpp", "cxx", "hpp", "hh", "hxx", "m", "mm"),
    "javascript": ("js", "mjs", "cjs", "jsx", "ts", "tsx", "mts", "cts"),
    "python": ("py",),
    "go": ("go",),
    "rust": ("rs",),
    "nim": ("nim",),
    "java": ("java",),
}
ASSET_TEXTS = ("md", "txt", "json", "yaml", "yml", "toml", "zon", "html", "css", "xml", "svg", "csv")
MANIFESTS = ("package.json", "build.zig.zon", "go.mod", "Cargo.toml", "pyproject.toml", "pom.xml", "build.gradle", "build.gradle.kts")
NODE_MODULES = "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split()
RUST_CRATES = ("std", "core", "alloc", "proc_macro", "test", "crate", "self", "super")
PYTHON_MODULES = tuple(sorted(sys.stdlib_module_names))
NIM_MODULES = """
    algorithm async asyncdispatch asyncfile asyncfutures asynchttpserver asyncjs asyncmacro asyncnet asyncstreams atomics
    base64 bitops browsers cgi chains colors complex cookies coro cpuinfo cpuload critbits cstrutils deques distros dom
    dynlib encodings endians epoll fenv future hashcommon hashes heapqueue hotcodereloading htmlgen htmlparser httpclient
    httpcore inotify intsets jsconsole jscore jsffi json jsre kqueue lenientops lexbase linenoise linux lists locks
    logging macrocache macros marshal math md5 memfiles mersenne mimetypes nativesockets net nimhcr nimprof nimrtl nre
    oids openssl options os ospaths osproc oswalkdir parsecfg parsecsv parsejson parseopt parsesql parseutils parsexml
    pathnorm pcre pcre2 pegs posix posix_freertos_consts posix_haiku posix_linux_amd64 posix_linux_amd64_consts
    posix_macos_amd64 posix_nintendoswitch posix_nintendoswitch_consts posix_openbsd_amd64 posix_other posix_other_consts
    posix_utils prelude random rationals rdstdin re registry reservedmem rlocks ropes rtarrays segfaults selectors
    sequtils setimpl sets sharedlist sharedtables ssl_certs ssl_config stats streams streamwrapper strformat strmisc
    strscans strtabs strutils sugar sums system tableimpl tables terminal termios threadpool times tinyc typeinfo
    typetraits unicode unidecode unittest uri volatile winlean xmlparser xmltree
""".split()
JDK_PACKAGES = """
    com.sun.java.accessibility.util com.sun.jdi com.sun.jdi.connect com.sun.jdi.connect.spi com.sun.jdi.event
    com.sun.jdi.request com.sun.management com.sun.net.httpserver com.sun.net.httpserver.spi com.sun.nio.file
    com.sun.nio.sctp com.sun.security.auth com.sun.security.auth.callback com.sun.security.auth.login
    com.sun.security.auth.module com.sun.security.jgss com.sun.source.doctree com.sun.source.tree com.sun.source.util
    com.sun.tools.attach com.sun.tools.attach.spi com.sun.tools.javac com.sun.tools.jconsole javax.accessibility
    javax.annotation.processing javax.crypto javax.crypto.interfaces javax.crypto.spec javax.imageio javax.imageio.event
    javax.imageio.metadata javax.imageio.plugins.bmp javax.imageio.plugins.jpeg javax.imageio.plugins.tiff
    javax.imageio.spi javax.imageio.stream javax.lang.model javax.lang.model.element javax.lang.model.type
    javax.lang.model.util javax.management javax.management.loading javax.management.modelmbean javax.management.monitor
    javax.management.openmbean javax.management.relation javax.management.remote javax.management.remote.rmi
    javax.management.timer javax.naming javax.naming.directory javax.naming.event javax.naming.ldap javax.naming.ldap.spi
    javax.naming.spi javax.net javax.net.ssl javax.print javax.print.attribute javax.print.attribute.standard
    javax.print.event javax.rmi.ssl javax.script javax.security.auth javax.security.auth.callback
    javax.security.auth.kerberos javax.security.auth.login javax.security.auth.spi javax.security.auth.x500
    javax.security.cert javax.security.sasl javax.smartcardio javax.sound.midi javax.sound.midi.spi javax.sound.sampled
    javax.sound.sampled.spi javax.sql javax.sql.rowset javax.sql.rowset.serial javax.sql.rowset.spi javax.swing
    javax.swing.border javax.swing.colorchooser javax.swing.event javax.swing.filechooser javax.swing.plaf
    javax.swing.plaf.basic javax.swing.plaf.metal javax.swing.plaf.multi javax.swing.plaf.nimbus javax.swing.plaf.synth
    javax.swing.table javax.swing.text javax.swing.text.html javax.swing.text.html.parser javax.swing.text.rtf
    javax.swing.tree javax.swing.undo javax.tools javax.transaction.xa javax.xml javax.xml.catalog javax.xml.crypto
    javax.xml.crypto.dom javax.xml.crypto.dsig javax.xml.crypto.dsig.dom javax.xml.crypto.dsig.keyinfo
    javax.xml.crypto.dsig.spec javax.xml.datatype javax.xml.namespace javax.xml.parsers javax.xml.stream
    javax.xml.stream.events javax.xml.stream.util javax.xml.transform javax.xml.transform.dom javax.xml.transform.sax
    javax.xml.transform.stax javax.xml.transform.stream javax.xml.validation javax.xml.xpath netscape.javascript
    org.ietf.jgss org.w3c.dom org.w3c.dom.bootstrap org.w3c.dom.css org.w3c.dom.events org.w3c.dom.html org.w3c.dom.ls
    org.w3c.dom.ranges org.w3c.dom.stylesheets org.w3c.dom.traversal org.w3c.dom.views org.w3c.dom.xpath org.xml.sax
    org.xml.sax.ext org.xml.sax.helpers sun.misc sun.reflect
""".split()


def extension(path: Column) -> Column:
    """What follows the last dot of the name; null for a name that begins with its only dot."""
    both = lambda b: F.struct(b.alias("name"), F.substring_index(b, ".", -1).alias("last"))
    return bound(bound(basename(path), both), lambda x: F.when((x["last"] != "") & (F.length(x["name"]) > F.length(x["last"]) + 1), x["last"]))


def language_of(path: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for name, of in EXTENSIONS.items() for e in of for x in (e, name))), extension(path))


def asset_text(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*ASSET_TEXTS), F.lit(False))


def kinds_of(path: Column) -> Column:
    """The kinds of references that a file of this name can hold."""
    lang, none = language_of(path), F.array().cast("array<string>")
    code = F.when(lang.isNull(), none).when(lang.isin("javascript", "python"), F.array(*map(F.lit, ("import", "test", "type_only", "dynamic")))).otherwise(F.array(F.lit("import"), F.lit("test")))
    link = F.when(extension(path) == "md", F.array(F.lit("link"))).otherwise(none)
    return F.concat(code, link, F.when(asset_text(path), F.array(F.lit("asset"))).otherwise(none))


def is_manifest(path: Column) -> Column:
    return basename(path).isin(*MANIFESTS) | basename(path).rlike(r"(?s)^.+\.nimble$")


def test_file(path: Column) -> Column:
    """Whether the conventions of its language make a file a test."""
    return bound(F.struct(path.alias("path"), basename(path).alias("name"), language_of(path).alias("lang")), lambda x: _test_name(x["path"], x["name"], x["lang"]))


def _test_name(path: Column, b: Column, lang: Column) -> Column:
    return (
        F.when(lang == "go", F.endswith(b, F.lit("_test.go")))
        .when(lang == "python", b.rlike(r"^test_|_test\.py$"))
        .when(lang == "nim", b.rlike("^test") | (b.rlike("^t") & path.rlike("(^|/)tests/")))
        .when(lang == "javascript", path.rlike("(^|/)__tests__/") | b.rlike(r"\.(test|spec)\.[^.]+$"))
        .when(lang == "java", path.rlike("(^|/)src/[^/]*[tT]est[^/]*/"))
        .otherwise(F.lit(False))
    )


def dependency_scope(manifest: Column, group: Column) -> Column:
    """runtime, development, optional or build, from the manifest's name and the group of a declaration."""
    b, first = basename(manifest), F.substring_index(group, ",", 1)
    return (
        F.when(b == "package.json", F.when(group == "devDependencies", "development").when(group == "optionalDependencies", "optional").otherwise("runtime"))
        .when(b == "pyproject.toml", F.when(group.isin("project.dependencies", "tool.poetry.dependencies"), "runtime").when(F.startswith(group, F.lit("project.optional-dependencies.")), "optional").otherwise("development"))
        .when(F.endswith(b, F.lit(".nimble")), F.when(F.startswith(group, F.lit("taskRequires.")), "development").when(F.startswith(group, F.lit("feature.")), "optional").otherwise("runtime"))
        .when(b == "pom.xml", F.when(first == "test", "development").when(F.endswith(group, F.lit(",optional")), "optional").when(first == "provided", "build").otherwise("runtime"))
        .when(b.isin("build.gradle", "build.gradle.kts"), F.when(group.rlike("^test|Test"), "development").when(group.rlike("^(compileOnly|compileOnlyApi|annotationProcessor|kapt|ksp|classpath)$|(CompileOnly|AnnotationProcessor)$"), "build").otherwise("runtime"))
        .when(b == "Cargo.toml", F.when(group.rlike(r"(^|\.)dev-dependencies($|\.)"), "development").when(group.rlike(r"(^|\.)build-dependencies($|\.)"), "build").otherwise("runtime"))
        .otherwise(F.lit("runtime"))
    )


def dependency_revision(manifest: Column, source: Column, requirement: Column) -> Column:
    """The revision that a declaration pins: what follows # or, in Python, the last @ of a remote source."""
    b = basename(manifest)
    of = F.when(source != "", source).otherwise(requirement)
    return F.when(b == "go.mod", "").when(of.contains("#"), F.regexp_extract(of, "(?s)#(.*)$", 1)).when((b == "pyproject.toml") & of.rlike("://.*@"), F.regexp_extract(of, "(?s)@([^@/]*)$", 1)).otherwise("")


def dependency_short_name(manifest: Column, name: Column) -> Column:
    """The artifact of Maven and Gradle, the last element of a Go module before its version, an npm name without scope."""
    b = basename(manifest)
    return (
        F.when(b.isin("pom.xml", "build.gradle", "build.gradle.kts"), F.substring_index(name, ":", -1))
        .when(b == "go.mod", F.regexp_extract(name, r"([^/]*?)(?:/v(?:[2-9]|[1-9][0-9]+))?$", 1))
        .when((b == "package.json") & F.startswith(name, F.lit("@")), F.substring_index(name, "/", -1))
        .otherwise(name)
    )


def package_of(ecosystem: str, name: Column) -> Column:
    """The package that a reference names outside the files, or null."""
    first = lambda sep: F.substring_index(name, sep, 1)
    if ecosystem == "npm":
        scoped = F.regexp_extract(name, "^(@[^/]+/[^/]+)", 1)
        plain = F.when(name.rlike("^[A-Za-z0-9]") & ~name.contains(":") & ~first("/").isin(*NODE_MODULES), first("/"))
        return F.when(F.startswith(name, F.lit("@")), F.when((scoped != "") & ~name.contains(":"), scoped)).otherwise(plain)
    if ecosystem == "python":
        return F.when(~F.startswith(name, F.lit(".")) & ~first(".").isin(*PYTHON_MODULES), first("."))
    if ecosystem == "cargo":
        crate = F.substring_index(F.regexp_replace(name, "^::", ""), "::", 1)
        return F.when(~crate.isin(*RUST_CRATES), crate)
    if ecosystem == "go":
        return F.when(first("/").contains("."), name)
    if ecosystem == "zig":
        return F.when(~name.rlike(r"\.(zig|zon)$") & ~name.isin("std", "builtin", "root"), name)
    if ecosystem == "nim":
        bare = F.regexp_replace(name, "^pkg/", "")
        return F.when(~name.rlike("^[./]|^std/|^system($|/)") & ~name.isin(*NIM_MODULES), F.substring_index(bare, "/", 1))
    if ecosystem == "java":
        lead = F.regexp_extract(name, r"^([a-z][^.]*(?:\.[a-z][^.]*)*)", 1)
        return F.when((lead != "") & ~lead.rlike(r"^(java|jdk)(\.|$)") & ~lead.isin(*JDK_PACKAGES), lead)
    raise ValueError(ecosystem)
