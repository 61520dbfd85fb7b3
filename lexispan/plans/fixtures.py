"""Small literal tables for what the driver's tables don't hold: component and markup files, binary files, listings."""

RAZOR = """@page "/orders/{id}"
@page "/o"
@layout MainLayout
@namespace App.Pages
@using System.Linq
@using   App.Data
@implements IDisposable
@inherits PageBase
@typeparam TItem
@attribute [Authorize(Roles = "x")]
@inject IStore Store
@inject  ILog   Log
<OrderList Items="@items" button@onclick="Go" a@OnClick b@onchange c@onclick />
<p>text</p><Grid.Row /><OrderList />
@code {
  [Parameter] public string Title { get; set; }
  [Parameter(CaptureUnmatchedValues = true)] public List<int> Ids { get; set; }
  [ Parameter ] int lower { get; set; }
}
"""
AXAML = """<Window x:Class="App.Main" xmlns:vm="using:App.Vm" xmlns : local = "clr-x">
  <Style x:Key="Accent"/><Brush x:Key=" Accent "/>
  <TextBox x:Name="Box" Text="{Binding Name, Mode=OneWay}" Classes="big red"/>
  <Button x:Name="box" Content="{Binding  name}" Background="{StaticResource Accent}" Foreground="{DynamicResource Fore Ground}"/>
  <Image Source="avares://App/a.png"/><Text Text="{Binding Other}"/>
</Window>
"""
FILES = [
    ("ui/Order.razor", ".razor", RAZOR),
    ("ui/Order.razor.cs", ".cs", "class Order {}"),
    ("ui/Main.axaml", ".axaml", AXAML),
    ("ui/Main.axaml.cs", ".cs", "class Main {}"),
    ("ui/Lone.razor", ".razor", "no directives"),
    ("ui/Lone.cs", ".cs", "class Lone {}"),
    ("ui/Away.razor.cs", ".cs", "class Away {}"),
    ("ui/Upper.RAZOR", ".RAZOR", "@page \"/u\"\n"),
    ("ui/note.md", ".md", "@page \"/not\"\n"),
]
BLOBS = [("empty", ""), ("text", "68656C6C6F"), ("nul_first", "0068"), ("nul_in_probe", "616263006465"), ("nul_after_probe", "61626364656667680000"), ("looks_like_nul", "100010")]
RULES = ["# comment", "", "docs/src1*/", "!docs/src11/", "*.toml", "/docs/src2/**/d1?.*", "docs/*/fr/", "!d7*.json", "src4"]
#: The same rules as ordered (pattern, ignored), by hand.
RULES_BY_HAND = [("^docs/src1[^/]*/.*$", True), ("^docs/src11/.*$", False), (r"^(.*/)?[^/]*\.toml(/.*)?$", True), (r"^docs/src2/(.*/)?d1[^/]\.[^/]*(/.*)?$", True), ("^docs/[^/]*/fr/.*$", True), (r"^(.*/)?d7[^/]*\.json(/.*)?$", False), ("^(.*/)?src4(/.*)?$", True)]
VOCABULARY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "the", "of", "and", "er", "##er", "##ing", "##ed", "##ion", "th", "##th", "##at", "an", "##an", "re", "##re", "in", "##in", "on", "##on", "t", "##t", "e", "##e", "s", "##s", ".", ",", "src"]
